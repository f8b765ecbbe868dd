"""What a chain of document filters removes in every order, from one pass over the rows.

Each row fails a set of filters; rows are counted by that set and by part, at most 32 cells a part for five filters. A walk
through all subsets of filters in Gray code toggles one filter at a time: each cell keeps the number of its failures that
are active, and enters or leaves the running survivors when that number leaves or reaches zero. The survivors of all 32
subsets are kept, and each step of each order is the difference of two of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words, per cent of the words, per cent of the code points
MARKS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    data = text.encode()
    words = data.split()  # bytes split at 0x20 and 0x09-0x0D
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (
        len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * len(text),
        MARKS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failures(docs: DataFrame) -> DataFrame:
    """(part, doc_id, fails, digest) of every row: filters A to D by its whole text; null text is empty, null lang is ''."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("part"), batch.column("doc_id"), pa.array([text_failures(t) for t in texts], pa.int32()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())], ["part", "doc_id", "fails", "digest"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return common.map_batches(rows, one, "part string, doc_id bigint, fails int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters that they fail.

    Filter E fails if a smaller doc_id has the same text. Rows without a doc_id have none smaller and no labels. Repeated
    rows count each; a doc_id with several labels has a mark if one of them does. The rows' slim form is stored and the
    rest reads only that; the smallest id of a text is combined before the shuffle, and rows meet it by their own id, so a
    text that a third of the rows share is dealt to all tasks.
    """
    slim = common.stored(failures(docs), "audit-rows")
    named = slim.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = named.groupBy("part", "doc_id", "fails", "digest").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "part", F.when(F.col("first"), F.col("fails")).otherwise(F.col("fails") + COPY).alias("mask"), "n",
        F.when(F.col("good") == 1, F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic") == 1, F.col("n")).otherwise(0).alias("toxic"))
    unnamed = slim.where("doc_id IS NULL").groupBy("part", F.col("fails").alias("mask")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", "mask", "n", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    return joined.unionByName(unnamed).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def survivors(mask: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of each subset of filters (row: the subset's bits) by a Gray-code walk over the cells of one part."""
    active = np.zeros(len(mask), dtype=np.int64)
    running = counts.sum(axis=0)
    out = np.zeros((1 << filters, counts.shape[1]), dtype=np.int64)
    out[0] = running
    subset = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1  # Gray code toggles the place of the lowest set bit
        subset ^= 1 << bit
        touched = (mask >> bit) & 1 == 1
        if subset >> bit & 1:
            running = running - counts[touched & (active == 0)].sum(axis=0)
            active[touched] += 1
        else:
            active[touched] -= 1
            running = running + counts[touched & (active == 0)].sum(axis=0)
        out[subset] = running
    return out


def orders(states: np.ndarray, letters: str) -> Iterator[tuple]:
    """(filter_order, step, counts…) of every order and step, as differences of the states."""
    n, whole = len(letters), len(states) - 1
    kept = states[:, 0]
    shapley = [sum(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) * int(kept[s] - kept[s | 1 << f])
                   for s in range(whole + 1) if not s >> f & 1) for f in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            lost = states[before] - states[after]
            failing = kept[0] - kept[1 << f]
            yield ("".join(letters[x] for x in order), step, int(kept[after]), int(lost[0]), int(failing - lost[0]),
                   int(kept[whole & ~(1 << f)] - kept[whole]), int(lost[1]), int(lost[2]), shapley[f])
            before = after


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from cells.

    One task holds the at most 2^n cells of a part. No rows give no parts.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        states = survivors(frame["mask"].to_numpy(np.int64), frame[["n", "good", "toxic"]].to_numpy(np.int64), len(letters))
        out = pd.DataFrame(list(orders(states, letters)), columns=["filter_order", "step", *COUNTS])
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    return counted.groupBy("part").applyInPandas(walk, schema)


def audit_sql(letters: str = LETTERS) -> str:
    """The same rows in DuckDB's SQL, by filtering in every order."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    chain = " AND ".join(f"(strpos(substr(filter_order, 1, {{upto}}), '{x}') = 0 OR NOT fail_{x})" for x in letters)
    before, after = chain.format(upto="step - 1"), chain.format(upto="step")
    own = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{x}' THEN fail_{x}" for x in letters) + " END"
    others = " AND ".join(f"(substr(filter_order, step, 1) = '{x}' OR NOT fail_{x})" for x in letters)
    names = [f"l{i}" for i in range(len(letters))]
    distinct = " AND ".join(f"{a}.l <> {b}.l" for i, a in enumerate(names) for b in names[:i])
    fails = [
        f"len(w) < {LEAST_WORDS}", f"100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w)",
        f"100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t)", "regexp_matches(t, '[#$%&*|]')",
        "coalesce(least_id < doc_id, false)"]
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents),
split AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS least_id FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {', '.join(f'{f} AS fail_{x}' for x, f in zip(letters, fails))}
  FROM split LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, {', '.join(f'fail_{x}' for x in letters)}, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
l AS (SELECT unnest({list(letters)}) AS l),
filter_orders AS (SELECT {' || '.join(f'{x}.l' for x in names)} AS filter_order FROM {', '.join(f'l AS {x}' for x in names)} WHERE {distinct}),
steps AS (SELECT filter_order, unnest(range(1, {len(letters) + 1})) AS step FROM filter_orders),
counted AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
  coalesce(sum(n) FILTER (WHERE {after}), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE {before} AND {own}), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE NOT ({before}) AND {own}), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE {own} AND {others}), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE {before} AND {own}), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE {before} AND {own}), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTS[:-1])},
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted"""
