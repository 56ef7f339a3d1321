"""Evidence of the critical review in Arrow: sentences, features, scores and choice, a part of a batch of rows at a time.

Patterns run in RE2, whose time doesn't grow with the number of alternatives. They say what the Java patterns of ``review_values``
say: words of letters, digits and marks of any script at a boundary, ASCII alone for case, digits and white space.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.functions import review_values as rv
from litmill.functions.text import BLANKS

pc = pa.compute
PART_BYTES = 8_000_000  # text of the rows that are worked on at once, unless one row has more

_WORD = r"\p{L}\p{Nd}\p{Mn}_"
_BEFORE, _AFTER = f"(?:^|[^{_WORD}])", f"(?:[^{_WORD}]|$)"
_RUNS = "(?: *[\t\n\x0b\f\r]| {2})[ \t\n\x0b\f\r]*"  # white space that isn't one blank
_LIST = re.compile(r"[0-9][0-9.±]*[\n\r\x85\u2028\u2029]?")


# ---- texts ------------------------------------------------------------------------------------------


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _holds(x: pa.Array, pattern: str) -> np.ndarray:
    return _flags(pc.match_substring_regex(x, pattern))


def _any_of(x: pa.Array, needles: list[str]) -> np.ndarray:
    return _holds(x, "|".join(re.escape(n) for n in needles))


def _each_of(x: pa.Array, needles: list[str]) -> dict[str, np.ndarray]:
    """For each needle whether it occurs; each is looked for where any of them is."""
    at = np.flatnonzero(_any_of(x, needles))
    some, out = x.take(pa.array(at)), {n: np.zeros(len(x), bool) for n in needles}
    for n, flags in out.items():
        flags[at] = _holds(some, re.escape(n))
    return out


def _matches(x: pa.Array, pattern: str) -> np.ndarray:
    """Whether a Java pattern of words occurs; ``x`` in lower-case ASCII where the pattern ignores case."""
    body = re.sub(r"\\b(?=[(\w])", lambda _: _BEFORE, pattern.removeprefix("(?i)"))
    return _holds(x, body.replace(r"\b", _AFTER))


def _changed(x: pa.Array, where: np.ndarray, change) -> pa.Array:
    """``change`` on the few texts ``where`` it may matter."""
    if not where.any():
        return x
    return pc.replace_with_mask(x, pa.array(where), pa.array([change(t) for t in x.filter(pa.array(where)).to_pylist()], pa.string()))


def lowered(x: pa.Array) -> pa.Array:
    """Lower case; the two letters whose small form is more than a letter, or depends on the next one, go the long way."""
    where = _holds(x, "[İΣ]")
    out = pc.utf8_lower(x)
    if not where.any():
        return out
    return pc.replace_with_mask(out, pa.array(where), pa.array([t.lower() for t in x.filter(pa.array(where)).to_pylist()], pa.string()))


def squeezed(x: pa.Array) -> pa.Array:
    return pc.ascii_trim(pc.replace_substring_regex(x, _RUNS, " "), BLANKS)


def cleaned(x: pa.Array) -> pa.Array:
    """White space squeezed, bullets and points at the ends gone."""
    return pc.ascii_trim(pc.replace_substring_regex(squeezed(x), r"^[\-*•]+ *", ""), " .")


def _cut(x: pa.Array, at: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, and which text each is of."""
    lists = pc.split_pattern(x, at)
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy()


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All sentences of ``texts`` in order, and the place of their text: lines, cut after ``.``, ``!`` or ``?`` before white space."""
    lines, of = _cut(pc.replace_substring(pc.fill_null(texts, ""), "\r", "\n"), "\n")
    lines = squeezed(lines)
    parts, line = _cut(pc.replace_substring_regex(lines, "([.!?]) ", "\\1\n"), "\n")
    some = pc.and_(pc.not_equal(parts, ""), pc.not_equal(parts, "Not found"))
    return parts.filter(some), of[line[_flags(some)]]


def _first_segment(t: str) -> str:
    parts = [p.strip(BLANKS) for p in t.split("|")]
    return parts[0] if len(parts[0]) > 15 else " — ".join(p for p in parts[:2] if p)


def _is_dump(t: str) -> bool:
    parts = [p.strip(BLANKS) for p in t.split(",")]
    return len(parts) > 4 and sum(_LIST.fullmatch(p) is not None for p in parts) / len(parts) > 0.5


@lru_cache(1)
def _numbers() -> tuple[re.Pattern, re.Pattern]:
    """A number, and a number with a metric, between word boundaries as Java knows them: letters, decimal digits and marks of any script."""
    kinds = {c: unicodedata.category(c) for c in map(chr, range(128, sys.maxunicode + 1))}
    of = lambda *names: "".join(c for c, kind in kinds.items() if kind in names)
    word, mark = rf"[^\W{of('No', 'Nl')}]", f"[{of('Mn')}]"
    before, after = f"(?<!{word})(?<!{mark})", f"(?!{word})(?!{mark})"
    metric = f"{before}[0-9][0-9.]*[{BLANKS}]*(?:%(?={word})|(?:f1|accuracy|bleu|rouge|auc|map){after})"
    return re.compile(f"{before}([0-9][0-9,.]*)(?:(?<=[0-9]){after}|(?<=[,.])(?={word}))"), re.compile(metric)


def _first_number(t: str) -> str:
    found = _numbers()[0].search(t)
    return found[1] if found else ""


# ---- features ---------------------------------------------------------------------------------------


def specific(texts: pa.Array) -> np.ndarray:
    """Names something concrete (dataset, metric, omission) or pairs a number with a unit."""
    t = cleaned(texts)
    ascii_low = pc.ascii_lower(t)
    named = _matches(ascii_low, rv.SPECIFIC) | (_holds(t, "[0-9]") & _matches(ascii_low, rv.SPECIFIC_UNIT))
    return named & ~_any_of(lowered(t), rv.GENERIC_PHRASES)


def _features(whole: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(t, low, usable): what is shown of an item, the same in lower case, and whether it may be evidence at all."""
    t = cleaned(whole)
    t = _changed(t, _holds(t, r"\|"), _first_segment)
    low = lowered(t)
    usable = _flags(pc.greater_equal(pc.utf8_length(t), 12))
    usable &= ~(_holds(t, r"\{") & _holds(t, r"\}")) & ~_any_of(low, rv.GENERIC_PHRASES)
    lists = np.flatnonzero(_flags(pc.greater_equal(pc.count_substring(t, ","), 4)) & usable)
    usable[[i for i, s in zip(lists.tolist(), t.take(pa.array(lists)).to_pylist(), strict=True) if _is_dump(s)]] = False
    return t, low, usable


def _values(low: pa.Array) -> np.ndarray:
    """A number for the value that an item gives for a metric, -1 without one."""
    out = np.full(len(low), -1)
    at = np.flatnonzero(_any_of(low, rv.METRIC_WORDS) & _holds(low, "[0-9]"))
    codes: dict[str, int] = {"": -1}
    for i, s in zip(at.tolist(), low.take(pa.array(at)).to_pylist(), strict=True):
        out[i] = codes.setdefault(_first_number(s), len(codes))
    return out


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Places of the first of each key, in order."""
    return np.sort(np.unique(keys, return_index=True)[1])


def _chosen(at: np.ndarray, row: np.ndarray, low: np.ndarray, value: np.ndarray, concrete: np.ndarray, limit: int) -> np.ndarray:
    """Of the items ``at``, row after row and best first: distinct texts, one per metric value, concrete ones only when a row has any."""
    at = at[_firsts(row[at] * (low.max(initial=0) + 1) + low[at])]
    keep = value[at] < 0
    valued = np.flatnonzero(~keep)
    keep[valued[_firsts(row[at[valued]] * (value.max(initial=0) + 1) + value[at[valued]])]] = True
    at = at[keep]
    has = np.zeros(row.max(initial=0) + 1, bool)
    has[row[at[concrete[at]]]] = True
    at = at[concrete[at] | ~has[row[at]]]
    return at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < limit]


def _lists(t: pa.Array, at: np.ndarray, place: np.ndarray, n: int, gone: np.ndarray) -> pa.ListArray:
    """``n`` lists of the texts ``at``, of which each goes to its ``place`` (in order); null where ``gone``."""
    ends = np.searchsorted(place, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), t.take(pa.array(at)), mask=pa.array(gone))


def _parts(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """The rows in parts of about PART_BYTES."""
    n = len(columns[0])
    size = max(1, n * PART_BYTES // max(1, sum(c.nbytes for c in columns)))
    for i in range(0, max(n, 1), size):
        yield [c.slice(i, size) for c in columns]


def _of_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, none null, and the place of their list."""
    return pc.fill_null(lists.flatten().cast(pa.string()), ""), pc.list_parent_indices(lists).to_numpy()


# ---- choice -----------------------------------------------------------------------------------------


def clean_lists(items: Column, limit: int) -> Column:
    """At most ``limit`` of an array's items, in order: see ``review.clean_evidence``."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def clean(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([_clean(part, limit) for (part,) in _parts([lists])])

    return clean(items)


def _clean(lists: pa.Array, limit: int) -> pa.ListArray:
    whole, row = _of_lists(lists)
    t, low, usable = _features(whole)
    some = np.flatnonzero(usable)
    t, low, row = t.take(pa.array(some)), low.take(pa.array(some)), row[some]
    at = _chosen(np.arange(len(t)), row, _codes(low), _values(low), specific(t), limit)
    return _lists(t, at, row[at], len(lists), _flags(lists.is_null()))


def _codes(x: pa.Array) -> np.ndarray:
    return x.dictionary_encode().indices.to_numpy().astype(np.int64)


@F.arrow_udf(T.IntegerType())
def count_specific(lists: pa.Array) -> pa.Array:
    """How many items of an array are concrete; null for no array."""
    out = []
    for (part,) in _parts([lists]):
        texts, row = _of_lists(part)
        out.append(pa.array(np.bincount(row, specific(texts), len(part)).astype(np.int32), mask=_flags(part.is_null())))
    return pa.concat_arrays(out)


def word_points(low: pa.Array) -> np.ndarray:
    """A row for each lower-case sentence, a column for each dimension: points for the words of a score that are plain text."""
    found: dict[tuple[str, ...], np.ndarray] = {}

    def some(words: list[str]) -> np.ndarray:
        key = tuple(words)
        if key not in found:
            found[key] = _any_of(low, words).astype(np.int32)
        return found[key]

    every = some(["not ", "only ", "missing", "limited", "unclear"]) * 2
    out = np.empty((len(low), len(rv.DIMENSIONS)), np.int32)
    for i, d in enumerate(rv.DIMENSIONS):
        out[:, i] = every
        for flags in _each_of(low, rv.KEYWORDS[d]).values():
            out[:, i] += 3 * flags
        if d in rv.REQUIRED:
            out[:, i] -= 6 * (1 - some(rv.REQUIRED[d]))
        if d == "reproducibility":
            out[:, i] -= 15 * (some(rv.RESULT_WORDS) & (1 - some(rv.SETUP_WORDS)))
    return out


def _scores(whole: pa.Array, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score of every item in every dimension, and which are about an architecture."""
    ascii_low = pc.ascii_lower(whole)
    common = 4 * pc.count_substring_regex(whole, "[0-9]").to_numpy() + 2 * _holds(whole, "%") + _flags(pc.greater(pc.utf8_length(whole), 40))
    score = word_points(low) + common[:, None]
    built = _matches(ascii_low, rv.ARCHITECTURE_NOISE)
    at = list(rv.DIMENSIONS).index
    score[:, at("threats_to_validity")] -= 6 * built
    score[:, at("applicability")] -= 6 * built + 6 * _matches(ascii_low, rv.APPLICABILITY_NOISE)
    score[:, at("reproducibility")] -= 12 * (_matches(ascii_low, rv.RESULT_NOISE) & ~_any_of(low, rv.SETUP_WORDS))
    return score, built


def best_items(sections: list[str], dimensions: list[str], limit: int, figures: bool):
    """A function of the text columns ``sections`` (and of the texts and scopes of key figures): the evidence for each of ``dimensions``."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def choose(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([_best(part, sections, dimensions, limit, figures) for part in _parts(list(columns))])

    return choose.asNondeterministic()


def _best(columns: list[pa.Array], sections: list[str], dimensions: list[str], limit: int, figures: bool) -> pa.ListArray:
    n, texts = len(columns[0]), columns[: len(sections)]
    gone = np.zeros(n, bool)
    whole, of = split_texts(pa.concat_arrays(texts)) if texts else (pa.array([], pa.string()), np.zeros(0, np.int64))
    row, section = of % max(n, 1), of // max(n, 1)
    scope = pa.array(np.full(len(whole), ""), pa.string())
    if figures:
        gone = _flags(columns[-2].is_null())
        items, owner = _of_lists(columns[-2])
        whole, scope = pa.concat_arrays([whole, items]), pa.concat_arrays([scope, _of_lists(columns[-1])[0]])
        row, section = np.append(row, owner), np.append(section, np.full(len(items), len(sections)))
    t, low, usable = _features(whole)
    some = np.flatnonzero(usable & ~gone[row])
    whole, t, low, scope = (x.take(pa.array(some)) for x in (whole, t, low, scope))
    row, section = row[some].astype(np.int64), section[some]
    whole_low = lowered(whole)
    score, built = _scores(whole, whole_low)
    code, value, concrete = _codes(low), _values(low), specific(t)
    names = np.array([*sections, "key_figures"])
    ats = []
    for d in dimensions:
        sources = rv.EVIDENCE_SOURCES[d]
        place = np.array([sources.index(s) if s in sources else 9 for s in names])
        ok = (place < 9) & (names != "key_figures")
        ok = ok[section]
        if "key_figures" in sources and rv.FIGURE_SCOPE.get(d):
            figure = np.flatnonzero(section == len(sections))
            fits = _any_of(scope.take(pa.array(figure)), rv.FIGURE_SCOPE[d])
            if d != "strengths":
                fits &= _any_of(whole_low.take(pa.array(figure)), rv.KEYWORDS[d])
            ok[figure] = fits
        if d == "threats_to_validity":
            ok &= ~built
        at = np.flatnonzero(ok)
        at = at[np.lexsort((at, place[section[at]], -score[at, list(rv.DIMENSIONS).index(d)], row[at]))]
        ats.append(_chosen(at, row, code, value, concrete, limit))
    k = len(dimensions)
    place = np.concatenate([row[at] * k + i for i, at in enumerate(ats)])
    order = np.argsort(place, kind="stable")
    lists = _lists(t, np.concatenate(ats)[order], place[order], n * k, np.repeat(gone, k))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), lists)


# ---- assessments ------------------------------------------------------------------------------------


def on_dimension(d: Column, verdict: Column, items: Column, limit: int) -> Column:
    """At most ``limit`` cleaned items that fit the dimension: absence claims, its required words or keywords (softer dimensions keep
    all). A negative verdict keeps those without a positive claim, if there are any; contradicted ones go."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def fit(d: pa.Array, verdict: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([_fitting(*part, limit) for part in _parts([d, verdict, lists])])

    return fit.asNondeterministic()(d, verdict, items)  # as all that is read more than once: evaluated once, never put into another expression


def _per_row(lists: pa.ListArray, keep: np.ndarray, row: np.ndarray, items: pa.Array) -> pa.ListArray:
    """The items to ``keep`` of every list."""
    at = np.flatnonzero(keep)
    return _lists(items, at, row[at], len(lists), _flags(lists.is_null()))


def _fitting(d: pa.Array, verdict: pa.Array, lists: pa.Array, limit: int) -> pa.ListArray:
    items, row = _of_lists(lists)
    low, of = lowered(items), np.array(d.to_pylist(), object)[row]
    keep = np.ones(len(items), bool)
    for name, words in rv.REQUIRED.items():
        own = np.flatnonzero(of == name)
        some = low.take(pa.array(own))
        keep[own] = _matches(some, rv.ABSENCE) | _any_of(some, words + rv.KEYWORDS[name])
    lists = _clean(_per_row(lists, keep, row, items), limit)
    negative = [any(v is not None and v.startswith(p) for p in rv.NEGATIVE_VERDICTS.get(x, [])) for x, v in zip(d.to_pylist(), verdict.to_pylist(), strict=True)]
    items, row = _of_lists(lists)
    quiet = ~_matches(pc.ascii_lower(items), rv.POSITIVE_NOISE)
    has = np.bincount(row, quiet, len(lists)) > 0
    lists = _per_row(lists, quiet | ~(np.array(negative, bool) & has)[row], row, items)
    items, row = _of_lists(lists)
    doubted = np.unique(row[_any_of(lowered(items), rv.NOT_EVALUATED)]).tolist()
    if not doubted:
        return lists
    rows = lists.to_pylist()
    for i in doubted:
        rows[i] = _uncontradicted(rows[i])
    return pa.array(rows, pa.list_(pa.string()))


def _uncontradicted(items: list[str]) -> list[str]:
    """``review.uncontradicted`` for one list."""
    lows = lowered(pa.array(items, pa.string())).to_pylist()
    named = lambda low: any(t in low for t in rv.DATASET_TOKENS) and re.search("[0-9]", low)
    measured = [low for low in lows if _numbers()[1].search(low) or named(low)]

    def kept(low: str) -> bool:
        same = any(t in low and any(t in m for m in measured) for t in rv.DATASET_TOKENS)
        task = "text classification" in low and any(t in m for m in measured for t in rv.TEXT_DATASETS)
        return not (any(n in low for n in rv.NOT_EVALUATED) and (same or task))

    return [x for x, low in zip(items, lows, strict=True) if kept(low)]


TEXTS = T.ArrayType(T.StringType())
SETTLED = T.StructType(
    [T.StructField(c, t) for c, t in zip(
        ["e", "n", "text", "empty", "items", "n_items", "generic"],
        [TEXTS, T.IntegerType(), T.StringType(), T.BooleanType(), TEXTS, T.IntegerType(), T.BooleanType()],
        strict=True,
    )]
)


def settled(d: Column, said: Column, items: Column) -> Column:
    """What the guards of an assessment need to know of its evidence.

    ``text``: what is ``said`` and the evidence, in lower case; ``n``: concrete items; ``empty``: nothing or generic phrases alone.
    ``e``: the evidence, for fairness with a note that no controls are named where none are. ``items``: what is kept of ``e`` for
    the dimension, with its concrete items and whether a generic phrase is in it.
    """

    @F.arrow_udf(SETTLED)
    def settle(d: pa.Array, said: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([_settled(*part) for part in _parts([d, said, lists])])

    return settle.asNondeterministic()(d, said, items)


def _joined(items: pa.Array, lists: pa.ListArray) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())).astype(np.int32)), items)
    return pc.binary_join(lists, " ")


def _settled(d: pa.Array, said: pa.Array, lists: pa.Array) -> pa.StructArray:
    items, row = _of_lists(lists)
    n, size = len(lists), np.bincount(row, minlength=len(lists))
    concrete = np.bincount(row, specific(items), n).astype(np.int32)
    text = lowered(squeezed(pc.binary_join_element_wise(said, _joined(items, lists), " ")))
    empty = (size == 0) | (_any_of(text, rv.GENERIC_PHRASES) & (concrete == 0))
    fair = _flags(pc.equal(d, "fairness_of_comparison"))
    control = np.bincount(row, _any_of(lowered(items), rv.CONTROL_WORDS), n) > 0
    noted = np.flatnonzero(fair & ~control & ~empty)
    if len(noted):
        new = [*lists.take(pa.array(noted)).to_pylist()]
        new = dict(zip(noted.tolist(), _clean(pa.array([[*x, rv.NO_CONTROLS] for x in new], pa.list_(pa.string())), 5).to_pylist(), strict=True))
        lists = pa.array([new.get(i, x) for i, x in enumerate(lists.to_pylist())], pa.list_(pa.string()))
        items, row = _of_lists(lists)
    noise = _flags(pc.equal(d, "applicability"))[row] & _matches(pc.ascii_lower(items), rv.APPLICABILITY_NOISE)
    kept = _per_row(lists, ~noise, row, items)
    left, row = _of_lists(kept)
    generic = _any_of(lowered(squeezed(_joined(left, kept))), rv.GENERIC_PHRASES)
    columns = [lists, concrete, text, empty, kept, np.bincount(row, specific(left), n).astype(np.int32), generic]
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["e", "n", "text", "empty", "items", "n_items", "generic"])


# ---- papers -----------------------------------------------------------------------------------------

HEAD = 64  # characters: more than any word that a guard looks for has
SOURCE_FLAGS = {
    "strong": rv.STRONG_FOUNDATIONAL, "typed": rv.FOUNDATIONAL_TYPE_WORDS, "extending": rv.EXTENSION_SIGNALS,
    **rv.NOVELTY_TYPE_WORDS,
}
MARKS = T.ArrayType(
    T.StructType([*[T.StructField(c, T.StringType()) for c in ("dimension", "head", "tail")], T.StructField("found", TEXTS)])
)


def marks(names: list[str]):
    """A function of the texts ``names`` of a paper: for each dimension with a guard that reads it, what is ``found`` in the part it reads.

    ``head`` is the start of that part and ``tail`` its last sentence, for what goes on in the assessment; ``found`` for signals leaves the
    last sentence out.
    """

    @F.arrow_udf(MARKS)
    def look(*texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_marks(dict(zip(names, part, strict=True))) for part in _parts(list(texts))])

    return look.asNondeterministic()


def _found(flags: dict[str, np.ndarray], n: int) -> pa.ListArray:
    """The names of the flags that are set, for each row."""
    if not flags:
        return pa.array([[]] * n, pa.list_(pa.string()))
    row, name = np.nonzero(np.stack(list(flags.values()), axis=1))
    return _lists(pa.array(list(flags)), name, row, n, np.zeros(n, bool))


def _signals(text: pa.Array, signals: dict[str, list[str]]) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The groups that a sentence without negation mentions, the last one left out, and the last one."""
    parts, row = _cut(pc.replace_substring_regex(text, "([.!?]) ", "\\1\n"), "\n")
    last = np.append(row[1:] != row[:-1], np.ones(min(1, len(row)), bool))
    low = lowered(parts)
    plain = ~last & ~_matches(low, rv.NEGATION)
    at = np.full(len(text), -1)
    at[row[last]] = np.flatnonzero(last)
    tail = pc.fill_null(parts.take(pa.array(at, mask=at < 0)), "")
    return {name: np.bincount(row, plain & _any_of(low, ks), len(text)) > 0 for name, ks in signals.items()}, tail


def _marks(texts: dict[str, pa.Array]) -> pa.ListArray:
    n = len(next(iter(texts.values())))
    parts = {}
    for name, x in texts.items():
        x = squeezed(pc.fill_null(x, ""))
        parts[name] = pc.if_else(pc.equal(x, ""), "", pc.binary_join_element_wise(x, " ", ""))

    def text(*names: str) -> pa.Array:
        columns = [parts[c] for c in names if c in parts]
        return pc.ascii_rtrim(pc.binary_join_element_wise(*columns, ""), " ") if columns else pa.array([""] * n, pa.string())

    source, sections = text(*parts), text(*rv.PAPER_SECTIONS)
    low, low_sections = lowered(source), lowered(sections)
    setup, fair = text("methodology", "abstract"), text(*parts, "abstract", "introduction")
    assumed = text("methodology", "introduction", "abstract")
    threats = {"worded": _any_of(low_sections, rv.THREAT_TOKENS)}
    repro, repro_tail = _signals(setup, rv.REPRO_SIGNALS)
    fairness, fair_tail = _signals(fair, rv.FAIRNESS_SIGNALS)
    rows = {
        "novelty": (source, None, {k: _any_of(low, ws) for k, ws in SOURCE_FLAGS.items()}),
        "reproducibility": (setup, repro_tail, repro),
        "fairness_of_comparison": (fair, fair_tail, fairness),
        "applicability": (source, None, _each_of(low, rv.DEPLOY_SIGNALS)),
        "weaknesses": (sections, None, threats),
        "threats_to_validity": (sections, None, threats),
        "assumptions": (assumed, None, {"worded": _any_of(lowered(assumed), rv.ASSUMPTION_TOKENS)}),
    }
    k = len(rows)
    columns = [
        pa.concat_arrays([pa.array([d] * n, pa.string()) for d in rows]),
        pa.concat_arrays([pc.utf8_slice_codeunits(x, 0, HEAD) for x, _, _ in rows.values()]),
        pa.concat_arrays([pa.nulls(n, pa.string()) if tail is None else tail for _, tail, _ in rows.values()]),
        pa.concat_arrays([_found(flags, n) for _, _, flags in rows.values()]),
    ]
    by_row = pa.array(np.arange(n * k).reshape(k, n).T.ravel())
    each = pa.StructArray.from_arrays([c.take(by_row) for c in columns], ["dimension", "head", "tail", "found"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), each)
