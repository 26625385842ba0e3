"""Source divergence audit: term shares of each source against the other sources and against its language.

One pass of ``bytes.translate`` lowers letters and blanks separators, ``bytes.split`` cuts, and a Counter per document
gives its terms and their counts, which each task sums by language, source and term before Spark sums them. What follows
is sparse (counts that occur) but for the sums over all kept terms of a pair of sources. Those are taken in blocks of
terms, each a matrix of about ``cells`` shares (sources by terms) in one task, or of as many terms as sources, if that is
more; blocks are summed by Spark. A language of very many sources also has its rows dealt to tiles, so that no task gives
more than about ``pairs`` sums.

Shares are whole numbers of a thousand millionth, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact arithmetic.

Defined cases: null text, lang and source count as ''. A row without terms still makes its group occur. Rows that share a
doc_id are documents of their own, as are repeated rows. A language without kept terms gives pairs of value 0 and no
terms; one with a single source gives no pairs. Empty tables give no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.byte_words import letters_table, word_pieces
from veilwork.llm.common import stage, tuples

TABLE = letters_table()
#: A task hands its counts on after so many entries, or after texts of so many bytes, which bound the terms' bytes.
ENTRIES, HELD_BYTES, BATCH = 700_000, 128 << 20, 20_000
#: Documents and occurrences of a term in one number, until a task hands them on; below the texts' bytes by far.
DOC_BITS = 40
ONE_DOC = 1 << DOC_BITS
SHARE, EXTRA = 1_000_000_000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; a group's row with the term '' holds its documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()),
                        ("docs", pa.int64())])

    def flush(counts):
        for (lang, source), c in counts.items():
            packed = np.fromiter(c.values(), np.int64, len(c))
            terms = pa.array(c, pa.binary())
            whole = [pa.repeat(lang, len(c)), pa.repeat(source, len(c)), terms, pa.array(packed & ONE_DOC - 1),
                     pa.array(packed >> DOC_BITS)]
            batch = pa.RecordBatch.from_arrays(whole, schema=schema)
            for at in range(0, len(c), BATCH):
                yield batch.slice(at, BATCH)

    def run(batches):
        counts: dict[tuple[str, str], dict[bytes, int]] = {}
        held = entries = 0
        for lang, source, text in tuples(batches):
            own = Counter((b"",))
            for words in word_pieces(text, TABLE):
                own.update(words)
            c = counts.setdefault((lang, source), {})
            get, entries = c.get, entries - len(c)
            for term, n in own.items():
                c[term] = get(term, 0) + ONE_DOC + n
            entries += len(c)
            held += len(text) + 64
            if entries > ENTRIES or held > HELD_BYTES:
                yield from flush(counts)
                counts.clear()
                held = entries = 0
        yield from flush(counts)

    none = F.lit("")
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), none) for c in ("lang", "source")),
                      F.coalesce(F.col("text").cast("string"), none).cast("binary"))
    found = src.toDF("lang", "source", "text").mapInArrow(
        run, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> F.Column:
    """p of a count, in decimals that hold any product of two counts."""
    return F.expr(f"1 + (cast({SHARE} as decimal(10,0)) * cast({count} + {EXTRA} as decimal(19,0))) "
                  f"div cast({total} + {EXTRA} * v as decimal(19,0))")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, cells: int = 100_000,
          pairs: int = 4_000_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``; part is 'pair' (every other source) or 'term' (at most ``top``)."""
    counts = stage(term_counts(docs), "terms")
    real = counts.where("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(
        F.col("docs") >= min_docs).select("lang", "term", "all_n")
    sparse = stage(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept")

    vocab = sparse.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    sums = sparse.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    here = counts.where("term = ''").select("lang", "source")
    sources = here.groupBy("lang").agg(F.count("*").alias("s"))
    groups = (here.join(sums, ["lang", "source"], "left").join(sources, "lang").join(vocab, "lang", "left")
              .select("lang", "source", "s", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "v", "lang_n"))))
    groups = stage(groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "group_n")))
                   .withColumn("blocks", F.expr(f"1 + v * s div greatest({cells}, least(s * s, {pairs}))"))
                   .withColumn("tiles", F.expr(f"1 + s * s div {pairs}")), "groups")

    shares = sparse.join(groups, ["lang", "source"]).withColumn("p", share("n", "group_n"))
    more = (shares.withColumn("value", F.col("p") - share("all_n", "lang_n")).where("value > 0")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = more.withColumn("rank", ranked).where(F.col("rank") <= top)
    apart = _pairs(shares, groups).withColumn("rank", ranked)
    return apart.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value)`` for every two sources of a language, both ways round."""
    block, tile = F.expr("pmod(xxhash64(term), blocks)"), F.explode(F.expr("sequence(0, tiles - 1)"))
    dealt = shares.select("lang", block.alias("block"), tile.alias("tile"), "source", "term", "p")
    lists = (groups.where("s > 1").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("lang", "block", tile.alias("tile"), "tiles", "source", "zero"))
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def block_sums(key, cells: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:
            return schema.empty_table()
        lang, _, tile = (k.as_py() for k in key)
        names = known["source"].to_pylist()
        order = sorted(range(len(names)), key=lambda k: names[k])
        names = [names[k] for k in order]
        sums: list[np.ndarray] = []
        mine = range(tile, len(names), known["tiles"][0].as_py())
        if cells.num_rows:
            place = {x: k for k, x in enumerate(names)}
            at = np.fromiter((place[x] for x in cells["source"].to_pylist()), np.int64, cells.num_rows)
            terms = cells["term"].combine_chunks().dictionary_encode()
            zero = known["zero"].to_numpy()[order]
            m = np.repeat(zero[:, None], len(terms.dictionary), 1)
            m[at, terms.indices.to_numpy()] = cells["p"].to_numpy()
            sums = [np.abs(m[a + 1:] - m[a]).sum(1) for a in mine]
        else:
            sums = [np.zeros(len(names) - a - 1, np.int64) for a in mine]
        first = [x for a, s in zip(mine, sums) for x in [names[a]] * len(s)]
        second = [x for a in mine for x in names[a + 1:]]
        return pa.table([pa.array([lang] * len(first), pa.string()), pa.array(first, pa.string()),
                         pa.array(second, pa.string()), np.concatenate(sums) if sums else pa.array([], pa.int64())],
                        schema=schema)

    key = ["lang", "block", "tile"]
    found = dealt.groupBy(*key).cogroup(lists.groupBy(*key)).applyInArrow(
        block_sums, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return found.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
