"""Filter interaction audit: what every order of a set of filters keeps and removes, step by step.

One pass over the texts gives each document a mask of the filters it fails; documents of a part with the same mask are one
cell, at most 2^k of them for k filters. A Gray-code walk then visits every subset of the filters, toggling one at a time:
each cell counts its active failures, and the running survivors change only by the cells whose counter leaves or reaches 0.
The 2^k states are stored; what a filter removes after others is the difference of two states, so no order is ever
run over documents. A part's walk is one task over at most 2^k narrow rows; texts never leave their scan, and
duplicates are found by joining on (text hash, id), which no group of copies makes hot.

Defined cases: null text is empty; a null part is the empty string, as is an empty one; a row with a null id is no copy of
anything and has no labels; of rows repeated with id and text none is a copy of another (no id is smaller); a document is
good or toxic if any row of labels says so; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

COUNTS = ["n", "good", "toxic"]
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: The filter that fails copies; it needs other rows, so it is no expression on one text.
COPIES = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text, by letter: few words, repeated words, capitals, signs."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.split(bare, r"[ \x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    return {
        "A": n < 100,
        "B": (bare != "") & (100 * F.size(F.array_distinct(words)) < 80 * n),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def walk(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """Survivors (2^filters x weights' columns) of each subset of filters, given cells' masks and weights, in Gray-code order."""
    states = np.zeros((1 << filters, weights.shape[1]), np.int64)
    failures, survivors, subset = np.zeros(len(masks), np.int64), weights.sum(0), 0
    states[0] = survivors
    for i in range(1, 1 << filters):
        bit = (i & -i).bit_length() - 1
        hit = (masks >> bit & 1).astype(bool)
        subset ^= 1 << bit
        if subset >> bit & 1:
            survivors = survivors - weights[hit & (failures == 0)].sum(0)
            failures[hit] += 1
        else:
            failures[hit] -= 1
            survivors = survivors + weights[hit & (failures == 0)].sum(0)
        states[subset] = survivors
    return states


def steps(states: np.ndarray, letters: str) -> Iterator[tuple]:
    """filter_order, step and counts of every step of every order, as differences of states."""
    k = len(letters)
    everything = (1 << k) - 1
    orders = list(permutations(range(k)))
    shapley = np.zeros(k, np.int64)
    for order in orders:
        done = 0
        for f in order:
            shapley[f] += states[done, 0] - states[done | 1 << f, 0]
            done |= 1 << f
    for order in orders:
        done = 0
        for step, f in enumerate(order, 1):
            lost = states[done] - states[done | 1 << f]
            fails = states[0, 0] - states[1 << f, 0]
            unique = states[everything ^ 1 << f, 0] - states[everything, 0]
            done |= 1 << f
            yield "".join(letters[g] for g in order), step, states[done, 0], lost[0], fails - lost[0], unique, lost[1], lost[2], shapley[f]


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters, part_col: str = "lang") -> tuple[DataFrame, str]:
    """part, mask, n, good, toxic of each cell, and the filters' letters, the lowest bit first."""
    named = filters(F.col("text"))
    letters = "".join(named) + COPIES
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(named.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = common.keep(rows.select("doc_id", "part", mask.alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h")), "masks")
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    joined = rows.join(first, ["h", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    out = joined.groupBy("part", (F.col("own") + F.when(copy, 1 << len(named)).otherwise(0)).alias("mask"))
    return out.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")), letters


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, part_col: str = "lang") -> DataFrame:
    """The report of every part, order and step: REPORT's columns."""
    found, letters = cells(docs, labels, filters, part_col)

    def report(frame: pd.DataFrame) -> pd.DataFrame:
        states = walk(frame["mask"].to_numpy(), frame[COUNTS].to_numpy(np.int64), len(letters))
        out = pd.DataFrame(steps(states, letters), columns=[c.split()[0] for c in REPORT.split(", ")][1:])
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    return found.groupBy("part").applyInPandas(report, REPORT)
