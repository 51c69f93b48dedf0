"""Full-text search over the indexed properties of resources.

A class table's indexed columns are read side by side, so a match is a filter
in the scan; only values stored as quads are first gathered by resource.
Words are runs of letters and digits, lower case. All terms must occur
somewhere in a resource, the last one as a prefix; quoted phrases within one
property.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError, QueryFailed
from ..runtime import materialise
from ..terms import DOUBLE, STRING, to_lex

_SPLIT = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75
_TEXTS = "array<struct<prop:string,weight:double,text:string>>"


@dataclass(frozen=True)
class Analysis:
    """How texts and queries become words; all of it runs as JVM expressions.

    ``stemmer`` is the S-stemmer: plural endings only. Words of digits alone go
    with ``ignore_numbers``.
    """

    unaccent: bool = False
    stemmer: bool = False
    ignore_numbers: bool = False
    stop_words: tuple[str, ...] = ()

    def words(self, text: Column) -> Column:
        text = F.lower(text)
        out = F.filter(F.split(F.translate(text, *_accents()) if self.unaccent else text, _SPLIT), lambda w: w != "")
        if self.ignore_numbers:
            out = F.filter(out, lambda w: ~F.rlike(w, F.lit("^[0-9]+$")))
        if self.stop_words:
            out = F.filter(out, lambda w: ~w.isin(*self.stop_words))
        return F.transform(out, _stem) if self.stemmer else out

    def of(self, text: str) -> list[str]:
        """The same for a query's text."""
        text = text.lower()
        text = text.translate(str.maketrans(*_accents())) if self.unaccent else text
        out = [w for w in re.split(r"[^\w]|_", text) if w and w not in self.stop_words and not (self.ignore_numbers and w.isdigit())]
        return [_stemmed(w) for w in out] if self.stemmer else out


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters that are one ASCII letter with marks, and those letters."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha() and all(map(unicodedata.combining, unicodedata.normalize("NFKD", a)[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _stem(w: Column) -> Column:
    cut = F.when(F.rlike(w, F.lit("[^ae]ies$")), F.regexp_replace(w, "ies$", "y")).when(F.rlike(w, F.lit("[^aeo]es$")), F.regexp_replace(w, "s$", ""))
    return cut.when(F.rlike(w, F.lit("[^us]s$")) & ~F.rlike(w, F.lit("(ies|es)$")), F.regexp_replace(w, "s$", "")).otherwise(w)


def _stemmed(w: str) -> str:
    if re.search("[^ae]ies$", w):
        return w[:-3] + "y"
    if re.search("[^aeo]es$", w) or re.search("[^us]s$", w) and not re.search("(ies|es)$", w):
        return w[:-1]
    return w


def analysis(c) -> Analysis:
    return c.data.options.get("analysis") or Analysis()


def parse(text: str, how: Analysis = Analysis()) -> tuple[list[str], list[list[str]]]:
    """Terms (the last may be a prefix) and phrases of a query text."""
    cut = how.of
    phrases = [cut(p) for p in re.findall(r'"([^"]*)"', text)]
    terms = cut(re.sub(r'"[^"]*"', " ", text))
    if not terms and not any(phrases):
        raise ParseError("an empty match")
    return terms, [p for p in phrases if p]


def texts(c, scope) -> DataFrame:
    """``s`` and the indexed texts of each resource."""
    onto = c.onto
    indexed = {p.iri: p for p in onto.properties.values() if p.fulltext}
    parts = []
    for t in c.data.tables:
        some = [p for p in t.columns if p in indexed]
        if some:
            cond = scope.condition(t.graph_column())
            df = t.df if cond is None else t.df.where(cond)
            s, ts = t.subject()
            each = [F.struct(F.lit(p).alias("prop"), F.lit(float(indexed[p].weight)).alias("weight"), F.expr(t.columns[p][0]).cast("string").alias("text")) for p in some]
            parts.append(df.select(to_lex(s, ts).alias("s"), F.array(*each).cast(_TEXTS).alias("texts")))
    if c.data.stored is not None and indexed:
        weights = F.create_map(*[F.lit(x) for p in indexed.values() for x in (p.iri, float(p.weight))])
        rows = c.data.stored.where(F.col("p").isin(*indexed))
        cond = scope.condition(F.col("g"))
        rows = rows if cond is None else rows.where(cond)
        rows = rows.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_set("o.lex")), ",").alias("text"))
        item = F.struct(F.col("p").alias("prop"), weights[F.col("p")].alias("weight"), "text")
        parts.append(rows.groupBy("s").agg(F.sort_array(F.collect_list(item)).cast(_TEXTS).alias("texts")))
    if not parts:
        raise QueryFailed("no property is indexed for full text")
    rows = reduce(DataFrame.union, parts)
    only = getattr(c, "subjects", None)
    return rows if only is None else rows.join(only, "s", "left_semi")


def _tokenised(c, scope, subjects: DataFrame | None = None, how: str = "left_semi") -> DataFrame:
    """``s``, and for each text its property, weight and words, made once; with or without some subjects."""
    words = analysis(c).words
    rows = texts(c, scope)
    rows = rows if subjects is None else rows.join(subjects, "s", how)
    each = F.transform(F.filter("texts", lambda t: t["text"].isNotNull()), lambda t: F.struct(t["prop"].alias("prop"), t["weight"].alias("weight"), t["text"].alias("text"), words(t["text"]).alias("w")))
    return rows.select("s", each.alias("_t"))


def _hit(w: Column, term: str, prefix: bool) -> Column:
    return F.startswith(w, F.lit(term)) if prefix else w == term


def _any(w: Column, asked: list[tuple[str, bool]]) -> Column:
    return reduce(lambda a, b: a | b, (_hit(w, x, k) for x, k in asked))


def _is(term: str, prefix: bool):
    return lambda w: _hit(w, term, prefix)


def _somewhere(term: str, prefix: bool) -> Column:
    return F.exists("_t", lambda t: F.exists(t["w"], _is(term, prefix)) if prefix else F.array_contains(t["w"], term))


def _phrase(words: list[str]) -> Column:
    inside = f" {' '.join(words)} "
    return F.exists("_t", lambda t: F.contains(F.concat(F.lit(" "), F.array_join(t["w"], " "), F.lit(" ")), F.lit(inside)))


def _asked(parsed: list) -> list[tuple[str, bool]]:
    """Every word looked for, and whether it may be a prefix."""
    return [(w, k == len(terms) - 1) for terms, _ in parsed for k, w in enumerate(terms)] + [(w, False) for _, phrases in parsed for p in phrases for w in p]


def search(c, queries: list[str], scope, calls: list[tuple[str, list]] = ()) -> tuple[DataFrame, list]:
    """``s`` of resources that all the query texts match, a column ``v<k>`` for each
    function call (name, constants), and the types of those columns."""
    how = analysis(c)
    parsed = [parse(q, how) for q in queries]
    stored = c.data.index
    if stored is not None and scope.unrestricted and all(name != "snippet" for name, _ in calls):
        return _by_postings(c, stored, parsed, scope, calls)
    rows = _tokenised(c, scope)
    cond = F.lit(True)
    for terms, phrases in parsed:
        for k, term in enumerate(terms):
            cond = cond & _somewhere(term, k == len(terms) - 1)
        for p in phrases:
            cond = cond & _phrase(p)
    asked = _asked(parsed)
    found, cols, types = rows.where(cond), [], []
    for k, (name, args) in enumerate(calls):
        if name == "rank":
            size = F.aggregate("_t", F.lit(0), lambda n, t: n + F.size(t["w"]))
            stats = [F.count("*").alias("_n"), F.avg(size).alias("_avg"), *(F.sum(_somewhere(*x).cast("int")).alias(f"_df{j}") for j, x in enumerate(asked))]
            found = found.crossJoin(F.broadcast(rows.agg(*stats)))  # one row
            tf = [F.aggregate("_t", F.lit(0.0), _weighted(*x)) for x in asked]
            c_, t_ = _bm25(tf, [F.col(f"_df{j}") for j in range(len(asked))], F.col("_n"), size, F.col("_avg")), DOUBLE
        elif name == "offsets":
            c_, t_ = _offsets(asked), STRING
        elif name == "snippet":
            c_, t_ = _snippet(how.words, asked, args), STRING
        else:
            raise ParseError(f"unknown full-text function {name}")
        cols.append(c_.alias(f"v{k}"))
        types.append(t_)
    return found.select("s", *cols), types


def _weighted(term: str, prefix: bool):
    return lambda a, t: a + t["weight"] * F.size(F.filter(t["w"], _is(term, prefix)))


def _bm25(tf: list[Column], df: list[Column], n: Column, size: Column, mean: Column) -> Column:
    score = F.lit(0.0)
    for x, d in zip(tf, df):
        score = score + F.log(1 + (n - d + 0.5) / (d + 0.5)) * x * (K1 + 1) / (x + K1 * (1 - B + B * size / mean))
    return score


def _local(prop: Column) -> Column:
    return F.regexp_extract(prop, r"[^#/]*$", 0)


def _offsets(asked) -> Column:
    at = F.flatten(F.transform("_t", lambda t: F.filter(F.transform(t["w"], lambda w, i: F.when(_any(w, asked), F.concat(_local(t["prop"]), F.lit(","), i.cast("string")))), lambda x: x.isNotNull())))
    return F.array_join(at, ",")


def _snippet(words, asked, args: list) -> Column:
    before, after = (args + [None, None])[:2]
    ellipsis = args[2] if len(args) > 2 and args[2] is not None else "…"
    n = int(args[3]) if len(args) > 3 and args[3] else 5
    first = F.get(F.filter("_t", lambda t: F.exists(t["w"], lambda w: _any(w, asked))), F.lit(0))["text"]
    raw = F.split(first, r"\s+")
    hit = F.transform(raw, lambda w: F.exists(words(w), lambda x: _any(x, asked)))
    start = F.greatest(F.array_position(hit, True).cast("int") - F.lit(n // 2), F.lit(1))
    marked = F.transform(F.slice(raw, start, n), lambda w: F.when(F.exists(words(w), lambda x: _any(x, asked)), F.concat(F.lit(before or ""), w, F.lit(after or ""))).otherwise(w))
    return F.concat(F.when(start > 1, ellipsis).otherwise(""), F.array_join(marked, " "), F.when(start + n <= F.size(raw), ellipsis).otherwise(""))


# -- stored postings


def index(c, scope) -> DataFrame:
    """Postings (term, s, prop, tf, length) as a table of their own."""
    return postings(c, scope).select("term", "s", "prop", F.size("at").cast("bigint").alias("tf"), "length")


def postings(c, scope) -> DataFrame:
    """A row for each term of each text: its positions, the text's length and the resource's.

    Words are gathered inside their row, so occurrences are not shuffled; only
    resources that several rows of a table name are merged by term.
    """
    several = materialise(texts(c, scope).groupBy("s").count().where("count > 1").select("s"), "several")

    def made(how: str) -> DataFrame:
        rows = _tokenised(c, scope, several, how).withColumn("total", F.aggregate("_t", F.lit(0), lambda n, t: n + F.size(t["w"])))
        rows = rows.select("s", "total", F.posexplode("_t").alias("part", "t")).select("s", "total", "part", F.col("t.prop").alias("prop"), F.col("t.weight").alias("weight"), F.size("t.w").alias("length"), F.explode(_gathered(F.col("t.w"))).alias("x"))
        return rows.select("x.term", "s", "part", "x.at", "prop", "weight", "length", "total")

    merged = made("left_semi").groupBy("term", "s", "part").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"), *(F.any_value(x).alias(x) for x in ("prop", "weight", "length", "total")))
    return made("left_anti").union(merged)


def _gathered(w: Column) -> Column:
    """Each different word and its positions, in one sort of the words."""

    def runs(a: Column, starts: Column) -> Column:
        at = lambda k, j: F.transform(F.slice(a, k + 1, F.coalesce(F.get(starts, j + 1), F.size(a)) - k), lambda x: x["i"])
        return F.transform(starts, lambda k, j: F.struct(F.get(a, k)["w"].alias("term"), at(k, j).alias("at")))

    def cut(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: (k == 0) | (F.get(a, k)["w"] != F.get(a, k - 1)["w"]))
        return F.flatten(F.transform(F.array(starts), lambda b: runs(a, b)))

    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    return F.when(F.size(w) > 0, F.flatten(F.transform(F.array(placed), cut)))


@dataclass(frozen=True)
class TextIndex:
    """Postings sorted by term and the length of every resource's text, with the subjects changed since.

    A search reads the files whose term ranges hold its words; subjects in
    ``touched`` are read from the data instead until the index is merged.
    """

    postings: DataFrame
    sizes: DataFrame
    touched: DataFrame | None = None

    @staticmethod
    def build(c, scope, write) -> TextIndex:
        """``write`` stores a DataFrame under a label and reads it again."""
        table = write(postings(c, scope).repartitionByRange("term").sortWithinPartitions("term"), "postings")
        sizes = _tokenised(c, scope).select("s", F.aggregate("_t", F.lit(0), lambda n, t: n + F.size(t["w"])).alias("total"))
        return TextIndex(table, write(sizes, "sizes"))

    def changed(self, subjects: DataFrame) -> TextIndex:
        return TextIndex(self.postings, self.sizes, subjects if self.touched is None else self.touched.union(subjects).distinct())

    def current(self, c, scope) -> tuple[DataFrame, DataFrame]:
        """Postings and sizes as the data is now."""
        if self.touched is None:
            return self.postings, self.sizes
        fresh = _Only(c, self.touched)
        size = F.aggregate("_t", F.lit(0), lambda n, t: n + F.size(t["w"])).alias("total")
        cols = self.postings.columns
        return self.postings.join(self.touched, "s", "left_anti").select(*cols).union(postings(fresh, scope).select(*cols)), self.sizes.join(self.touched, "s", "left_anti").union(_tokenised(fresh, scope).select("s", size))


class _Only:
    """A compiler whose texts are those of some subjects."""

    def __init__(self, c, subjects: DataFrame):
        self.c, self.subjects = c, subjects
        self.data, self.onto = c.data, c.onto


def _by_postings(c, stored: TextIndex, parsed: list, scope, calls: list) -> tuple[DataFrame, list]:
    table, sizes = stored.current(c, scope)
    asked = list(dict.fromkeys(_asked(parsed)))
    hits = table.where(_any(F.col("term"), asked))
    # One row a resource: weighted counts, and the positions of phrase words in each text.
    counts = [F.sum(F.when(_hit(F.col("term"), *x), F.size("at")).otherwise(0) * F.col("weight")).alias(f"_tf{k}") for k, x in enumerate(asked)]
    seen = [F.max(_hit(F.col("term"), *x)).alias(f"_in{k}") for k, x in enumerate(asked)]
    place = F.collect_list(F.struct("part", "prop", "term", "at")).alias("_at")
    by = hits.groupBy("s").agg(*counts, *seen, F.any_value("total").alias("_size"), place)
    cond = F.lit(True)
    for k in range(len(asked)):
        cond = cond & F.col(f"_in{k}")
    for _, phrases in parsed:
        for p in phrases:
            cond = cond & _follows(p)
    found, cols, types = by.where(cond), [], []
    for k, (name, _) in enumerate(calls):
        if name == "rank":
            whole = sizes.agg(F.count("*").alias("_n"), F.avg("total").alias("_avg"))
            df = by.agg(*(F.count_if(F.col(f"_in{j}")).alias(f"_df{j}") for j in range(len(asked))))
            found = found.crossJoin(F.broadcast(whole.crossJoin(df)))  # one row
            words = [asked.index(x) for x in _asked(parsed)]
            c_, t_ = _bm25([F.col(f"_tf{j}") for j in words], [F.col(f"_df{j}") for j in words], F.col("_n"), F.col("_size"), F.col("_avg")), DOUBLE
        elif name == "offsets":
            flat = F.flatten(F.transform("_at", lambda t: F.transform(t["at"], lambda i: F.struct(t["part"].alias("part"), i.alias("i"), t["prop"].alias("prop")))))
            c_, t_ = F.array_join(F.transform(F.array_sort(flat), lambda x: F.concat(_local(x["prop"]), F.lit(","), x["i"].cast("string"))), ","), STRING
        else:
            raise ParseError(f"unknown full-text function {name}")
        cols.append(c_.alias(f"v{k}"))
        types.append(t_)
    return found.select("s", *cols), types


def _follows(words: list[str]) -> Column:
    """Whether some text has the words one after another."""

    def begins(word: str, shift: int, part: Column) -> Column:
        here = F.filter("_at", lambda t: (t["part"] == part) & (t["term"] == word))
        return F.flatten(F.transform(here, lambda t: F.transform(t["at"], lambda i: i - shift)))

    def holds(part: Column) -> Column:
        starts = [begins(w, k, part) for k, w in enumerate(words)]
        return F.size(reduce(F.array_intersect, starts)) > 0

    return F.exists(F.array_distinct(F.transform("_at", lambda t: t["part"])), holds)


__all__ = ["Analysis", "TextIndex", "index", "parse", "search"]
