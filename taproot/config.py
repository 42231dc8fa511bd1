"""Settings of a run, with the geometry that follows from them, and their TOML form."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from typing import Any

Triple = tuple[int, int, int]


def _triple(v) -> Triple:
    a, b, c = v
    return int(a), int(b), int(c)


@dataclass(frozen=True)
class Segmentation:
    resolution_phys: Triple = (4, 4, 40)
    start_phys: Triple = (403560, 121800, 158000)
    shape_phys: Triple = (64000, 52000, 76000)
    downsample_factor: Triple = (10, 10, 1)
    leaf_shape_voxels: Triple = (64, 64, 64)
    fov_shape: Triple = (1240, 1240, 1240)
    incr_denom: float = 1.0
    use_sphere: bool = True
    interpolate_distance_nodes: int = 3

    def __post_init__(self):
        for f in fields(self):
            if isinstance(f.default, tuple):
                object.__setattr__(self, f.name, _triple(getattr(self, f.name)))

    @property
    def fov_shape_phys(self) -> Triple:
        return self.fov_shape

    @property
    def voxel_resolution(self) -> Triple:
        return _triple(r * d for r, d in zip(self.resolution_phys, self.downsample_factor, strict=True))

    @property
    def end_phys(self) -> Triple:
        return _triple(a + b for a, b in zip(self.start_phys, self.shape_phys, strict=True))

    @property
    def start_voxel(self) -> Triple:
        return _triple(a // v for a, v in zip(self.start_phys, self.voxel_resolution, strict=True))

    @property
    def shape_voxel(self) -> Triple:
        return _triple((a + v - 1) // v for a, v in zip(self.shape_phys, self.voxel_resolution, strict=True))

    @property
    def end_voxel(self) -> Triple:
        return _triple(a + b for a, b in zip(self.start_voxel, self.shape_voxel, strict=True))

    @property
    def fov_shape_voxels(self) -> Triple:
        return _triple(f // v for f, v in zip(self.fov_shape, self.voxel_resolution, strict=True))

    @property
    def seg_phys_bounds(self) -> tuple[Triple, Triple]:
        return self.start_phys, self.end_phys

    @property
    def seg_voxel_bounds(self) -> tuple[Triple, Triple]:
        return self.start_voxel, self.end_voxel

    def validate_fov_shape(self) -> None:
        """The field of view must be whole voxels, an odd number of them on each axis."""
        for f, v, n in zip(self.fov_shape, self.voxel_resolution, self.fov_shape_voxels, strict=True):
            if f % v:
                raise ValueError(f"field of view {f} is no multiple of the voxel {v}")
            if n % 2 == 0:
                raise ValueError(f"field of view of {n} voxels has no middle one")


@dataclass(frozen=True)
class Skeletons:
    csv: str | None = None
    output_file_base: str | None = None
    save_nodes: bool = True
    save_rankings: bool = True
    save_segmentations: bool = True
    save_meshes: bool = True
    save_masks: bool = True
    save_config: bool = True
    use_consensus: bool = False
    resample: bool = True
    smoothing: str = "none"
    resample_delta: int = 50
    resample_sigma: float = 0.05
    strahler_filter: bool = True
    min_strahler: int = 0
    max_strahler: int = 10_000


@dataclass(frozen=True)
class FragmentSource:
    sensitives_file: str | None = None
    threshold: float = 0.3
    shift: Triple = (0, 0, -40)

    def __post_init__(self):
        object.__setattr__(self, "shift", _triple(self.shift))


SECTIONS = {"segmentations": Segmentation, "skeleton": Skeletons, "fragments": FragmentSource}


@dataclass(frozen=True)
class Config:
    segmentations: Segmentation = field(default_factory=Segmentation)
    skeleton: Skeletons = field(default_factory=Skeletons)
    fragments: FragmentSource = field(default_factory=FragmentSource)

    @staticmethod
    def of(settings: dict[str, Any] | None = None) -> Config:
        """From nested settings; unknown keys are an error only if they are no keys of a section."""
        made = {}
        for name, kind in SECTIONS.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: v for k, v in (settings or {}).get(name, {}).items() if k in known})
        return Config(**made)

    @staticmethod
    def from_toml(*paths: str) -> Config:
        """Later files override earlier ones, table by table and key by key."""
        settings: dict[str, Any] = {}
        for path in paths:
            with open(path, "rb") as f:
                settings = merge(settings, tomllib.load(f))
        return Config.of(settings)

    def to_toml(self, path: str | None = None) -> str:
        lines = []
        for name in SECTIONS:
            lines.append(f"[{name}]")
            lines += [f"{k} = {_toml(v)}" for k, v in asdict(getattr(self, name)).items() if v is not None]
            lines.append("")
        text = "\n".join(lines)
        if path:
            with open(path, "w") as f:
                f.write(text)
        return text

    def __str__(self) -> str:
        return self.to_toml()


def merge(old: dict, new: dict) -> dict:
    out = dict(old)
    for k, v in new.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _toml(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(v, (tuple, list)):
        return "[" + ", ".join(map(_toml, v)) + "]"
    return repr(v)
