"""Search of many tokens at once in the rows of a table, by an automaton in each task."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import ship_package

#: Finds of so many different parts are kept by a task.
KEPT_PARTS = 100_000


def automaton(tokens: list[str]) -> ahocorasick.Automaton:
    """Aho–Corasick automaton whose values are the tokens' numbers (empty tokens are left out)."""
    auto = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        if t:
            auto.add_word(t, i)
    auto.make_automaton()
    return auto


def match_tokens(rows: DataFrame, tokens: list[tuple[str, str]]) -> DataFrame:
    """``rows`` whose column ``tokens`` holds, in place of parts of a text, the distinct values of the tokens that lie in a part.

    ``tokens`` is a list of a checked size, of (token, value).  A null list of parts gives an empty array; an empty token lies in any other.
    """
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(tokens)
    names = rows.columns
    at = names.index("tokens")
    schema = StructType([StructField(f.name, ArrayType(StringType()) if f.name == "tokens" else f.dataType) for f in rows.schema])

    def search(batches):
        values = {v: i for i, v in enumerate(dict.fromkeys(v for _, v in sent.value))}
        given: dict[str, list[int]] = {}
        for t, v in sent.value:
            given.setdefault(t, []).append(values[v])
        auto, numbers = automaton(list(given)), list(given.values())
        always = given.get("", [])
        words = pa.array(values, pa.string())
        kept: dict[str, tuple] = {}

        def finds(part):
            got = kept.get(part)
            if got is None:
                got = tuple({x for _, i in auto.iter(part) for x in numbers[i]}) if len(auto) else ()
                if len(part) <= 64:  # words come again, whole texts don't
                    if len(kept) >= KEPT_PARTS:
                        kept.clear()
                    kept[part] = got
            return got

        for b in batches:
            offsets, ids = [0], []
            for parts in b.column(at).to_pylist():
                if parts is not None:
                    found = set(always)
                    for part in parts:
                        found.update(finds(part))
                    ids.extend(found)
                offsets.append(len(ids))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(ids, pa.int64())))
            columns = [made if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(search, schema)


def put_together(rows: DataFrame, held: DataFrame, keep: list[StructField]) -> DataFrame:
    """``rows(keep..., tokens, _block)`` with the distinct strings that the words ``tokens`` hold by ``held(_of, key, held)`` of the row's block."""
    ship_package(rows.sparkSession)
    names = [f.name for f in keep]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists, words = (t.column(c).combine_chunks() for t, c in ((right, "held"), (left, "tokens")))
        strings = lists.flatten().dictionary_encode()
        first, last, numbers = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:], strings.indices.to_numpy()
        at = pc.index_in(words.flatten(), value_set=right.column("key").combine_chunks()).fill_null(-1).to_numpy()
        ends, made = words.offsets.to_numpy() - words.offsets[0].as_py(), []
        for a in range(0, left.num_rows, 500):
            here = ends[a : a + 501]
            row, word = np.repeat(np.arange(len(here) - 1), np.diff(here)), at[here[0] : here[-1]]
            row, word = row[word >= 0], word[word >= 0]
            sizes = last[word] - first[word]
            places = np.repeat(first[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            some = max(1, len(strings.dictionary))
            found = np.unique(np.repeat(row, sizes) * some + numbers[places - lists.offsets[0].as_py() if len(lists) else places])
            offsets = np.searchsorted(found, np.arange(len(here)) * some)
            made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.dictionary.take(pa.array(found % some))))
        return left.select(names).append_column("tokens", pa.chunked_array(made, pa.list_(pa.string())))

    schema = StructType([*keep, StructField("tokens", ArrayType(StringType()))])
    return rows.groupBy("_block").cogroup(held.groupBy("_of")).applyInArrow(run, schema)
