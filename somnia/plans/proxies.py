"""The given tables seen as recordings, epochs, votes and hypnograms.

Each view has a Spark form and, for the independent check, the same view as a
SQL common table expression.

* ``events`` is a two-channel signal: a user is a recording, ``value`` and the
  number in ``props`` are channels ``v`` and ``k``, the event type is the stage.
* ``events`` is also the table of scored epochs with a state code.
* ``lineitem`` holds votes: supplier is study, five classes.
* ``orders`` holds annotations and hypnogram intervals per customer.
* ``labels`` is a pair of true and predicted classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from somnia.functions.scalar import group_digit, lookup, most_frequent
from somnia.operators.latent import assign_states, unique_states
from somnia.operators.ordered import ordinal

FS = 4.0
EPOCH = 16
CLASSES = [0, 1, 2, 3, 4]
PSG = {"view": 0, "click": 1, "signup": 2, "error": 3, "purchase": 4}
RAT = {"view": 1, "click": 3, "signup": 5, "error": 4, "purchase": 0}
START = "1995-01-01"


def fin(df: DataFrame) -> DataFrame:
    """Result columns in plain types: BIGINT, DOUBLE at six places, STRING.

    The two engines' ``round`` differ on decimal halves, so both sides round
    the scaled number to the nearest even whole one.
    """
    out = []
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            out.append(F.col(name).cast("long").alias(name))
        elif kind in ("float", "double") or kind.startswith("decimal"):
            x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
            out.append((F.rint(x * 1e6) / 1e6 + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def out(ctes: str, select: str, ints: str = "", doubles: str = "") -> str:
    """Check SQL with the same plain types."""
    parts = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    parts += [f'round_even(CAST("{c}" AS DOUBLE) * 1e6, 0) / 1e6 + 0.0 AS "{c}"' for c in doubles.split()]
    head = f"WITH {ctes} " if ctes else ""
    star = f"* REPLACE ({', '.join(parts)})" if parts else "*"
    return f"{head}SELECT {star} FROM ({select}) AS result"


def _case(mapping: dict[str, int]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


def events(t) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("recording_id"), "event_id", F.col("value").alias("v"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("double").alias("k"),
        lookup(PSG, "event_type").alias("stage"))


def signal(t) -> DataFrame:
    """``recording_id sample_idx v k stage``, the index dense from 0."""
    return ordinal(events(t), ["recording_id"], "event_id", "sample_idx").drop("event_id")


SIG = f"""ev AS (SELECT user_id AS recording_id, event_id, value AS v,
 CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k, {_case(PSG)} AS stage FROM events),
sig AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY event_id) - 1 AS sample_idx, v, k, stage FROM ev)"""


def samples(t) -> DataFrame:
    """Long form: ``recording_id sample_idx channel value``."""
    return signal(t).select("recording_id", "sample_idx", F.explode(F.array(
        F.struct(F.lit("v").alias("channel"), F.col("v").alias("value")),
        F.struct(F.lit("k").alias("channel"), F.col("k").alias("value")))).alias("c")).select(
        "recording_id", "sample_idx", "c.*")


SAMP = SIG + """, samp AS (SELECT recording_id, sample_idx, 'v' AS channel, v AS value FROM sig
 UNION ALL SELECT recording_id, sample_idx, 'k', k FROM sig)"""


def epoch_labels(t) -> DataFrame:
    from somnia.operators.epochs import epoch_mode
    return epoch_mode(signal(t), ["recording_id"], "sample_idx", EPOCH, classes=CLASSES)


LAB = SIG + f""", labn AS (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, stage, count(*) AS n FROM sig GROUP BY ALL),
lab AS (SELECT recording_id, epoch_idx, stage FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, epoch_idx ORDER BY n DESC, stage) AS rn,
 sum(n) OVER (PARTITION BY recording_id, epoch_idx) AS total FROM labn) WHERE rn = 1 AND total = {EPOCH})"""


def coded_epochs(t) -> DataFrame:
    """``epoch_id subject grp stage code v k r``: one epoch per event, six-bit codes."""
    bit = lambda c: F.when(c, "1").otherwise("0")
    v, k = F.col("v"), F.col("k")
    base = t.events.select(
        F.col("event_id").alias("epoch_id"), F.col("user_id").alias("subject"), lookup(RAT, "event_type").alias("stage"),
        F.col("value").alias("v"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("double").alias("k"))
    return base.withColumns({
        "grp": group_digit("subject"), "r": v / (k + 1),
        "code": F.concat(bit(v > 5), bit(v > 15), bit(v > 35), bit(v > 70), bit(k >= 50), bit(k % 2 == 1))})


COD = f"""cod AS (SELECT *, CAST(substr(CAST(subject AS VARCHAR), 1, 1) AS INT) AS grp, v / (k + 1) AS r,
 (CASE WHEN v > 5 THEN '1' ELSE '0' END) || (CASE WHEN v > 15 THEN '1' ELSE '0' END) || (CASE WHEN v > 35 THEN '1' ELSE '0' END)
 || (CASE WHEN v > 70 THEN '1' ELSE '0' END) || (CASE WHEN k >= 50 THEN '1' ELSE '0' END) || (CASE WHEN k % 2 = 1 THEN '1' ELSE '0' END) AS code
 FROM (SELECT event_id AS epoch_id, user_id AS subject, {_case(RAT)} AS stage, value AS v,
 CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


def state_epochs(t) -> DataFrame:
    """``coded_epochs`` with the id of each code."""
    coded = coded_epochs(t)
    return assign_states(coded, unique_states(coded))


STA = COD + ", sta AS (SELECT *, dense_rank() OVER (ORDER BY code) AS latent_id FROM cod)"


def fine_epochs(t) -> DataFrame:
    """Coded epochs with five more bits, and whether an epoch is from the first half month."""
    fine = F.lpad(F.bin(F.least(F.floor(F.col("v") / 16), F.lit(31)).cast("long")), 5, "0")
    rows = coded_epochs(t).withColumn("code", F.concat("code", fine))
    early = t.events.select(F.col("event_id").alias("epoch_id"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"))
    return rows.join(early, "epoch_id")


FIN = COD + """, fine AS (SELECT c.* REPLACE (c.code || lpad(bin(CAST(least(floor(c.v / 16), 31) AS BIGINT)), 5, '0') AS code), e.ts < TIMESTAMP '2024-01-16' AS early
 FROM cod c JOIN events e ON e.event_id = c.epoch_id)"""


def votes(t) -> DataFrame:
    """``study_id epoch_idx true pred scores``: a row per vote of a channel set."""
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_suppkey").alias("study_id"), (p % 200).alias("epoch_idx"),
        (F.round(F.col("l_tax") * 100).cast("long") % 5).alias("true"), (q % 5).alias("pred"),
        F.array(*[((p + q * (c + 1)) % 11).cast("double") for c in range(5)]).alias("scores"))


VOT = """vot AS (SELECT l_suppkey AS study_id, l_partkey % 200 AS epoch_idx, CAST(round(l_tax * 100) AS BIGINT) % 5 AS true_,
 CAST(l_quantity AS BIGINT) % 5 AS pred, """ + ", ".join(
    f"CAST((l_partkey + CAST(l_quantity AS BIGINT) * {c + 1}) % 11 AS DOUBLE) AS s{c}" for c in range(5)) + " FROM lineitem)"


def pairs(t) -> DataFrame:
    """``study_id idx true pred`` per epoch: both sides by vote, in one aggregate."""
    return votes(t).groupBy("study_id", F.col("epoch_idx").alias("idx")).agg(
        most_frequent("true", CLASSES).alias("true"), most_frequent("pred", CLASSES).alias("pred"))


def _mode(col):
    return (f"(SELECT study_id, epoch_idx, {col} FROM (SELECT study_id, epoch_idx, {col}, row_number() OVER "
            f"(PARTITION BY study_id, epoch_idx ORDER BY count(*) DESC, {col}) AS rn FROM vot GROUP BY study_id, epoch_idx, {col}) WHERE rn = 1)")


PAI = VOT + f""", pai AS (SELECT a.study_id, a.epoch_idx AS idx, a.true_ AS true_, b.pred
 FROM {_mode('true_')} a JOIN {_mode('pred')} b ON a.study_id = b.study_id AND a.epoch_idx = b.epoch_idx)"""


def annotations(t) -> DataFrame:
    """``recording_id onset duration stage description``: a day per order from the start date."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit(START).cast("date"))
    return t.orders.select(
        F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("id"), (day * 86400).cast("double").alias("onset"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 86400.0 * 40).alias("duration"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("stage"), F.col("o_orderstatus").alias("description"))


ANN = f"""ann AS (SELECT o_custkey AS recording_id, o_orderkey AS id, CAST(date_diff('day', DATE '{START}', CAST(o_orderdate AS DATE)) * 86400 AS DOUBLE) AS onset,
 CAST(substr(o_orderpriority, 1, 1) AS INT) * 86400.0 * 40 AS duration, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS stage, o_orderstatus AS description FROM orders)"""


def hypnogram(t) -> DataFrame:
    """Disjoint intervals per recording, in seconds: whole 30 s epochs, some gaps, an offset."""
    lab = epoch_labels(t)
    return lab.where("stage <> 4").select(
        "recording_id", (F.col("epoch_idx") * 90 + 60).alias("init_sec"),
        F.when(F.col("stage") == 3, 0).otherwise(30 * (F.col("stage") + 1)).cast("long").alias("dur_sec"),
        F.concat(F.lit("S"), F.col("stage").cast("string")).alias("stage"))


HYP = LAB + """, hyp AS (SELECT recording_id, epoch_idx * 90 + 60 AS init_sec, CASE WHEN stage = 3 THEN 0 ELSE 30 * (stage + 1) END AS dur_sec,
 'S' || stage AS stage FROM lab WHERE stage <> 4)"""


def feature_vectors(t, n: int = 10) -> DataFrame:
    """``vec_id label f0 ... f9`` from the embeddings."""
    return t.embeddings.select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 10).alias(f"f{i}") for i in range(n)])


VEC = "vec AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS f{i}" for i in range(10)) + " FROM embeddings)"
VECTOR = [f"f{i}" for i in range(10)]
