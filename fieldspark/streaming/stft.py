"""Windows and coefficients of an unbounded stream of samples.

Samples arrive in any order within a watermark of event time.  A window is emitted
once, when its last missing sample arrives; state per series is the samples of the
windows still open, so it is bounded by the watermark and the window length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldspark.operators.spectra import transform
from fieldspark.operators.windows import WindowScheme


def stream_windows(samples: DataFrame, key: str, values: Sequence[str], s: WindowScheme, time: str = "t", delay: str = "10 minutes") -> DataFrame:
    """``samples(key, n, t, <values>)`` to (key, w, n0, <values> as arrays); windows count from sample 0."""
    kind = samples.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, w long, n0 long, " + ", ".join(f"`{v}` array<double>" for v in values)
    held = "n array<long>, x array<double>"
    width = len(values)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have: dict[int, list[float]] = {}
        if state.exists:
            n, x = state.get
            have = {int(m): list(x[i * width : (i + 1) * width]) for i, m in enumerate(n)}
        fresh = set()
        for pdf in batches:
            for row in pdf[["n", *values]].itertuples(index=False):
                m = int(row[0])
                if m not in have:
                    have[m] = [float(v) for v in row[1:]]
                    fresh.add(m)
        starts = sorted({w for m in fresh for w in range(max(0, -(-(m - s.length + 1) // s.advance)), m // s.advance + 1)})
        rows = []
        for w in starts:
            span = range(w * s.advance, w * s.advance + s.length)
            if all(m in have for m in span):
                rows.append((k[0], w, w * s.advance, *[[have[m][i] for m in span] for i in range(width)]))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "w", "n0", *values])
            # samples that only emitted windows could use are let go once nothing older can still be filled
            oldest = min((m for m in have if m >= rows[-1][2]), default=0)
            have = {m: v for m, v in have.items() if m > oldest - s.length}
        order = sorted(have)
        state.update((order, [v for m in order for v in have[m]]))
        if state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)

    marked = samples.withWatermark(time, delay)
    return marked.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_stft(samples: DataFrame, key: str, values: Sequence[str], s: WindowScheme, time: str = "t", delay: str = "10 minutes") -> DataFrame:
    """Coefficients of the stream's windows (detrended, tapered, scaled)."""
    return transform(stream_windows(samples, key, values, s, time, delay), list(values), s)
