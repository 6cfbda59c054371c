"""What a run is asked for, checked once."""

from __future__ import annotations

from dataclasses import dataclass

#: The usual number of neighbours, bins of a split search, and its tolerance.
DEFAULT_K, DEFAULT_BINS, DEFAULT_TOLERANCE = 300, 20, 0.002
#: Fixed value: by how many errors a density peak has to stand out, usually.
DEFAULT_Z = 3.0
DTYPES = {"f32": "<f4", "f64": "<f8"}


@dataclass(frozen=True)
class KnnConfig:
    """`cell_rows`: points that a cell is meant to hold; `block_rows`: points that meet others at once in a task;
    `routed_cells`: the most cells whose tree of boxes is shipped to every task; `first_routes`: other cells that a query
    visits before its radius is taken anew; `z`: how many errors a density peak has to stand out by."""

    k: int = DEFAULT_K
    dims: int | None = None
    dtype: str = "f64"
    compute: str = "f64"
    policy: str = "widest"
    cell_rows: int = 4096
    block_rows: int = 4096
    routed_cells: int = 65536
    first_routes: int = 8
    bins: int = DEFAULT_BINS
    tolerance: float = DEFAULT_TOLERANCE
    invalid: str = "raise"
    z: float = DEFAULT_Z

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be 1 or more")
        if self.dims is not None and self.dims < 1:
            raise ValueError("dims must be 1 or more")
        if self.dtype not in DTYPES or self.compute not in DTYPES:
            raise ValueError(f"dtype and compute must be one of {', '.join(DTYPES)}")
        if self.policy not in ("widest", "round_robin"):
            raise ValueError("policy must be widest or round_robin")
        if not 0 <= self.z < float("inf"):
            raise ValueError("z must be 0 or more")
        if self.invalid not in ("raise", "drop"):
            raise ValueError("invalid must be raise or drop")
        if min(self.cell_rows, self.block_rows, self.routed_cells, self.first_routes, self.bins) < 1 or not 0 < self.tolerance < 1:
            raise ValueError("cell_rows, block_rows, routed_cells, first_routes and bins must be 1 or more, and tolerance between 0 and 1")
