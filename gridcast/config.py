"""Settings of the four time granularities (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Granularity:
    minutes: int
    rows: int                 # slots in the full series
    day: int                  # slots per day = steps of one window
    thresh: int               # least known values per cell, sequence family
    arma_thresh: int          # the same, ARMA family
    train: int                # ARMA training slots
    order: tuple[int, int]    # ARMA order used for the forecast
    max_lag: int              # order search covers p, q < max_lag
    latent_lr: float
    latent_batch: int
    latent_batches: int
    latent_epochs: int
    lanes: int                # windows per sequence batch
    batches: int              # sequence batches per epoch
    init: tuple[str, float]   # weight initialiser and its scale
    bias: float
    evaluate: tuple[int, int, int, int]   # a, b, s, s2: windows a:b:s, then ::s2
    cell_size: int = 10
    lr: float = 0.01
    epochs: int = 20


# Fixed values, one line per granularity.
GRANULARITIES = {
    5: Granularity(5, 8594, 288, 8500, 935, 6000, (3, 1), 20, 0.008, 170, 50, 50,
                   300, 20, ("uniform", 1.0), 0.1, (6000, 8100, 7, 40)),
    15: Granularity(15, 2861, 96, 2820, 935, 2000, (3, 5), 20, 0.008, 128, 22, 40,
                    100, 20, ("normal", 1.0), 0.1, (2000, 2700, 7, 12)),
    30: Granularity(30, 1427, 48, 1410, 935, 1000, (10, 3), 13, 0.01, 128, 11, 40,
                    50, 20, ("normal", 1.0), 0.1, (1000, 1350, 7, 7)),
    45: Granularity(45, 946, 32, 935, 935, 700, (4, 2), 50, 0.08, 94, 10, 50,
                    70, 10, ("normal", 5.0), 0.0, (700, 910, 3, 10)),
}
GRID_START = "2014-06-01 00:00:00"
