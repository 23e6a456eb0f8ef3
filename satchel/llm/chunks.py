"""Content-defined cuts by a rolling gear hash, for bytes and for id streams."""

from __future__ import annotations

import numpy as np

from satchel.llm.shared import mix64

#: 32-bit gear values, by a fixed rule: the mixed index.
GEAR = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)
#: A gear hash of 32 bits forgets a symbol after as many steps.
MEMORY = 32


def gear(symbols: np.ndarray) -> np.ndarray:
    """At each place the hash of the MEMORY symbols that end there: the sum of the gear
    values, each shifted by its distance, modulo 2**32."""
    h = GEAR[symbols]
    width = 1
    while width < MEMORY:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(symbols: np.ndarray, offsets: np.ndarray, least: int, bits: int, most: int) -> list[list[int]]:
    """For each row of ``symbols`` (between ``offsets``) the ends of its chunks, from the
    row's start. A cut follows a symbol where the hash has ``bits`` leading zeros, at
    ``least`` symbols (more than MEMORY) from the last cut; no chunk is over ``most``. They
    depend on the row's own symbols only. An empty row has no chunks."""
    if least <= MEMORY:
        raise ValueError("chunks must be longer than the hash's memory")
    spots = np.flatnonzero(gear(symbols) < np.uint32(1 << (32 - bits))) + 1 if len(symbols) else np.zeros(0, np.int64)
    bounds = np.searchsorted(spots, offsets)
    out = []
    for k in range(len(offsets) - 1):
        start, end = int(offsets[k]), int(offsets[k + 1])
        ends, last = [], start
        for s in spots[bounds[k] : bounds[k + 1]].tolist():
            while s - last > most:
                last += most
                ends.append(last - start)
            if s - last >= least and s < end:
                ends.append(s - start)
                last = s
        while end - last > most:
            last += most
            ends.append(last - start)
        if end > last:
            ends.append(end - start)
        out.append(ends)
    return out
