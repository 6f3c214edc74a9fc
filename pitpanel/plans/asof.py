"""As-of lookups as one ordered pass over the union of both sides.

Neither a range join nor a whole-entity window: the merged rows are cut into time buckets
and the last right row travels between buckets as a carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.params import DAY
from pitpanel.plans.ordered import running, time_bucket


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
              cols: list[str], inclusive: bool = False, direction: str = "backward",
              bucket_ms: int = DAY) -> DataFrame:
    """Attach ``cols`` of the nearest right row to every left row (NULL where there is none).

    backward: latest right row before ``left_ts`` (at or before with ``inclusive``);
    forward: earliest right row after (at or after with ``inclusive``). ``(by, right_ts)``
    must be unique on the right, otherwise no engine defines the winner.
    """
    sign = 1 if direction == "backward" else -1
    left_tie, right_tie = (1, 0) if inclusive else (0, 1)
    payload_l = F.struct(*[F.col(c) for c in left.columns])
    payload_r = F.struct(*[F.col(c) for c in cols])
    keys_l = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    lhs = left.select(*keys_l, (F.col(left_ts) * sign).alias("_o"), F.lit(left_tie).alias("_tie"),
                      payload_l.alias("_l"))
    # a row without a key or a time never matches and never hides a match
    rhs = right.dropna(subset=[*by, right_ts]).select(*keys_l, (F.col(right_ts) * sign).alias("_o"),
                       F.lit(right_tie).alias("_tie"), payload_r.alias("_r"))
    merged = lhs.unionByName(rhs, allowMissingColumns=True)
    keys = [f"_k{i}" for i in range(len(by))]
    # left rows without a time sort first; spread them, they may be many
    undated = F.lit(-(2 ** 62)) + F.pmod(F.xxhash64("_l"), F.lit(1024))
    done = running(merged, keys, ["_o", "_tie"],
                   F.coalesce(time_bucket("_o", bucket_ms), undated),
                   {"_hit": ("last", F.col("_r"))})
    return (done.filter(F.col("_l").isNotNull())
            .select("_l.*", *[F.col("_hit")[c].alias(c) for c in cols]))
