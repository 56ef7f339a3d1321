"""How far the sources of a language diverge in their words, priced on joint tables of count levels.

In a language each source has one indicator column for every count that it gives to some term, 0 included: a term's row holds a
single 1 for each source. The product of these columns with their transpose is the joint table of every two sources: how many
terms have count c in one and d in the other. It is summed over blocks of terms, tile by tile of sources, in integers; the
divergence of two sources is then a price for each cell of their table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import LOWER, UPPER, release, table
from litmill.session import cut_lineage

MIN_DOCS, TOP = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
BLOCK, TILE = 8192, 32
HELD = 200_000  # counts that a task holds before it hands them on
#: Bytes of a term stay, A-Z in lower case; all others are blanks.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
JOINT = "lang string, source string, other string, level long, other_level long, n long"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of the texts, summed as far as a task holds them; term '' stands for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (n, d) in held.items():
                for c, v in zip(columns, ([lang] * len(n), [source] * len(n), n, n.values(), map(d.__getitem__, n)), strict=True):
                    c.extend(v)
            held.clear()
            strings = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*strings, *[pa.array(c, pa.int64()) for c in columns[3:]]], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, d = held[lang or "", source or ""]
                terms = (text.as_py() or "").encode().translate(TERM_BYTES).split()
                n.update(terms)
                d.update(set(terms))
                n[b""] += 0
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield handed()
        yield handed()
        release()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms). ``terms``: (lang, source, term, n, lang_n, first) of the kept terms, counts of 1 and more; ``first`` in one
    row of each term. ``groups``: (lang, source, total, terms, lang_total, tile) of every group, also those without terms."""
    # dealt by term, so that the sums of a source and of the language need one shuffle; a task's counts come summed
    rows = cut_lineage(counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    whole = Window.partitionBy("lang", "term")
    own = {"lang_n": F.sum("n"), "_docs": F.sum("docs"), "_least": F.min("source")}
    words = rows.where("term != ''").withColumns({c: v.over(whole) for c, v in own.items()})
    kept = words.where(F.col("_docs") >= min_docs)
    terms = cut_lineage(kept.select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("_least")).alias("first")))
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("_firsts"))
    lang = Window.partitionBy("lang")
    groups = rows.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["total", "_firsts"])
    groups = groups.withColumns({"terms": F.sum("_firsts").over(lang), "lang_total": F.sum("total").over(lang)})
    tile = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE)
    return cut_lineage(groups.withColumn("tile", tile.cast("int")).drop("_firsts")), terms


def product(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of X' Y for the indicator matrices X and Y of levels (terms x sources): source of X, of Y, their levels, terms.

    An indicator matrix is held as the places of its ones: one column for each term and source.
    """
    levels, places, width = [], np.empty(right.shape, np.int64), 0
    for t in range(right.shape[1]):
        own, at = np.unique(right[:, t], return_inverse=True)
        places[:, t] = at + width
        levels.append(own)
        width += len(own)
    flat, of = np.concatenate(levels), np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    for s in range(left.shape[1]):
        own, at = np.unique(left[:, s], return_inverse=True)
        cells, n = np.unique(at[:, None] * width + places, return_counts=True)
        x, y = cells // width, cells % width
        for t in range(right.shape[1]):
            in_t = of[y] == t
            yield s, t, own[x[in_t]], flat[y[in_t]], n[in_t]


def joint_tables(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """JOINT: every cell of the joint table of every two sources (source < other) of a language, level 0 included.

    The cells of a table add up to the language's kept terms. A task holds BLOCK terms of two tiles of TILE sources, about.
    """
    size = groups.groupBy("lang").agg(F.max("tile").alias("_tiles"), F.ceil(F.max("terms") / BLOCK).alias("_blocks")).where("_blocks > 0")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles"))).alias("_other")
    pair = [F.least("tile", "_other").alias("_i"), F.greatest("tile", "_other").alias("_j")]
    tiles = groups.join(size, "lang").select("lang", "source", "tile", "_tiles", "_blocks")
    dealt = terms.join(tiles, ["lang", "source"]).withColumn("_block", F.pmod(F.xxhash64("term"), F.col("_blocks")))
    rows = dealt.select("lang", "_block", "source", "tile", "term", "n", other).select("lang", "_block", *pair, "source", "term", "n")
    held = dealt.groupBy("lang", "_block").agg(F.count_if("first").alias("_held"))
    names = tiles.join(held, "lang").select("lang", "_block", "_held", "source", "tile", other).select("lang", "_block", "_held", *pair, "source", "tile")
    names = names.select(*[F.col(c).alias(c) for c in names.columns])

    def multiply(rows: pa.Table, names: pa.Table) -> pa.Table:
        lang, i, j, held = (names.column(c)[0].as_py() for c in ("lang", "_i", "_j", "_held"))
        tiles = list(zip(names.column("tile").to_pylist(), names.column("source").to_pylist(), strict=True))
        sides = [sorted(s for t, s in tiles if t == side) for side in (i, j)]
        term, source = (pa.array(rows.column(c).to_pylist(), pa.string()) for c in ("term", "source"))
        term, levels = term.dictionary_encode(), []
        for side in sides:
            m = np.zeros((len(term.dictionary), len(side)), np.int64)
            at = pa.compute.index_in(source, pa.array(side, pa.string()))
            has = at.is_valid().to_numpy(zero_copy_only=False)
            m[term.indices.to_numpy()[has], at.drop_null().to_numpy()] = rows.column("n").to_numpy()[has]
            levels.append(m)
        rest = held - len(term.dictionary)  # terms of the block that no source of these two tiles has
        out = [np.zeros((5, 0), np.int64)]
        for s, t, c, d, n in product(*levels):
            if sides[0][s] < sides[1][t]:
                out.append(np.stack([np.full(len(c) + 1, s), np.full(len(c) + 1, t), np.append(c, 0), np.append(d, 0), np.append(n, rest)]))
        cells = np.concatenate(out, axis=1)
        names_of = [pa.array(side, pa.string()).take(pa.array(k)) for side, k in zip(sides, cells[:2], strict=True)]
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros_like(cells[0]))), *names_of, *map(pa.array, cells[2:])]
        return pa.Table.from_arrays(columns, ["lang", "source", "other", "level", "other_level", "n"])

    key = ["lang", "_block", "_i", "_j"]
    cells = rows.groupBy(*key).cogroup(names.groupBy(*key)).applyInArrow(multiply, JOINT)
    return cells.groupBy("lang", "source", "other", "level", "other_level").agg(F.sum("n").alias("n")).where("n > 0")


def chance(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    up, down = (whole(count) + F.lit(PRIOR)) * F.lit(SCALE), whole(total) + whole(terms) * F.lit(PRIOR)
    return F.call_function("div", up, down) + F.lit(1)


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways; 0 without kept terms."""
    cells = joint_tables(groups, terms)
    a = groups.select("lang", "source", F.col("total").alias("_n"), F.col("terms").alias("_v"))
    b = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("_m"))
    cells = cells.join(a, ["lang", "source"]).join(b, ["lang", "other"])
    cost = price(chance("level", "_n", "_v"), chance("other_level", "_m", "_v")) * F.col("n")
    sums = cut_lineage(cells.groupBy("lang", "source", "other").agg(F.sum(cost).alias("value")))
    both = sums.select("lang", "source", F.col("other").alias("item"), "value").unionAll(sums.select("lang", "other", "source", "value"))
    all_pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    return all_pairs.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"])


def own_terms(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each kept term that a source has, and has more often than its language."""
    rows = terms.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    rows = rows.withColumns({"p": chance("n", "total", "terms"), "q": chance("lang_n", "lang_total", "terms")}).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int | None = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text; others are ignored).

    Part `pair`: the divergence of a source from each other one of its language. Part `term`: the ``top`` terms (None: all) by
    which it differs from its language. Null texts, languages and sources are ''. A language whose terms are all rarer than
    ``min_docs`` documents has pairs of value 0 and no terms; a lone source has no pairs. Ties go by item. Rows that repeat are
    documents of their own; an empty table gives no rows. Counts are exact up to 10^19, sums up to 2^63.
    """
    groups, terms = kept_counts(docs, min_docs)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergence(groups, terms).withColumn("rank", F.row_number().over(by))
    best = own_terms(groups, terms).withColumn("rank", F.row_number().over(by))
    best = best if top is None else best.where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionAll(shown(best, "term"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


SQL_OP13 = rf"""with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
g as (select distinct lang, source from d),
t as (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as (select lang, term from t group by lang, term having count(distinct k) >= 10),
c as (select t.lang, t.source, t.term, count(*) as n from t join v using (lang, term) group by all),
s as (select g.lang, g.source, (select count(*) from v where v.lang = g.lang) as v,
  (select coalesce(sum(n), 0) from c where c.lang = g.lang and c.source = g.source) as total from g),
x as (select s.lang, s.source, v.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v)::hugeint as p
  from s join v on v.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = v.term),
l as (select lang, sum(total) as total, max(v) as v from s group by lang),
y as (select x.lang, x.term, 1 + (1000000000::hugeint * (sum(x.n) + 2)) // (any_value(l.total) + 2 * any_value(l.v))::hugeint as q
  from x join l using (lang) group by x.lang, x.term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item,
    coalesce((select sum((x.p - z.p) * (x.p - z.p) // (x.p + z.p)) from x join x z on z.lang = x.lang and z.term = x.term
      where x.lang = a.lang and x.source = a.source and z.source = b.source), 0) as value
  from g a join g b on a.lang = b.lang and a.source != b.source),
terms as (select x.lang, x.source, 'term' as part, x.term as item, (x.p - y.q) * (x.p - y.q) // (x.p + y.q) as value
  from x join y using (lang, term) where x.n > 0 and x.p > y.q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from
  (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10"""
