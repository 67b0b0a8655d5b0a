"""The squelch: a gate that follows a running average of the level.

The average takes one eighth of each new level.  Below a third of the threshold the gain falls
by a twentieth; above the threshold it goes half the way back to one; in between it
holds.  A sample depends on all before it, so one ordered pass per signal is
the least there is: a loop over an Arrow array for a packed signal, in time
that grows with its length alone, and a carried state for packets in a stream.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.0025


def squelched(x: Column, full: float = 1.0, threshold: float = THRESHOLD) -> Column:
    """The gated samples of an array, as doubles (null for null); integers are to be cut towards zero."""

    @F.arrow_udf("array<double>")
    def gate(a: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(a), 0).to_numpy())])
        flat = a.flatten().to_numpy(zero_copy_only=False)
        out = [squelch_array(flat[s:e], full=full, threshold=threshold)[0] for s, e in zip(offsets, offsets[1:], strict=False)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*out, np.empty(0)])), mask=a.is_null())

    return gate(x.cast("array<double>"))


def squelch_array(x, avg: float = 1.0, gain: float = 1.0, full: float = 1.0, threshold: float = THRESHOLD):
    """(samples, avg, gain) of one packet in a worker, given the state so far."""
    out = np.empty(len(x))
    for i, v in enumerate(np.asarray(x, float).tolist()):
        avg = (7 * avg + abs(v) / full) / 8
        if avg < threshold / 3:
            gain *= 0.95
        elif avg > threshold:
            gain += (1 - gain) * 0.5
        out[i] = v * gain
    return out, avg, gain
