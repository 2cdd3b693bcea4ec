"""Quality rules by distribution divergence, in DataFrame operations only.

A document's characters, by class, and its words, by the commonest ones of its language, are
two histograms.  Each is compared with that of the language, pooled over all documents, by the
Jensen-Shannon distance.  A document diverges where the distance is greater than what is
allowed, and what is allowed grows as a document gets shorter: a sample of ``n`` words spread
over ``k`` bins lies about ``(k - 1) / (8 n ln 2)`` (squared distance) from where it was drawn,
so short clean texts are not taken for strange ones.

Everything about one document is found within its row, so texts are never shuffled: a first
pass counts the words of each language and a second one its characters, both with partial sums,
and the third pass scores.  The references are a row a language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Common words of a language, their length in bytes at most; words and characters from which a
#: document is compared; words that a language's reference needs.
COMMON, WORD_BYTES, MIN_WORDS, MIN_CHARS, MIN_REFERENCE = 32, 64, 50, 200, 2000
#: Squared distances allowed to long texts, and what is added for short ones: times the expected
#: squared distance of a sample for words, over the number of characters for characters.
WORD_LIMIT, WORD_SLACK, CHAR_LIMIT, CHAR_SLACK = 0.048, 1.4, 0.04, 25.0
#: Words of a window, percent of words in repeated windows and words below which the base rules fail.
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20
#: Languages up to which their references are broadcast; one takes some 2 KB.
MOST_BROADCAST = 2000
#: Languages up to which their common words are listed in one set.
MOST_LISTED = 100
#: Character classes, told apart in this order; what is left is the last class.
CLASSES = ["[a-z]+", "[A-Z]+", "[ \\t-\\r]+", "[#*$%&|<>]+", "[0-9]+", "[^\\x00-\\x7F]+", "[!-/:-@\\[-`{-~]+"]

_SPACES = " \t\n\x0b\x0c\r"


def words(text: str = "text") -> Column:
    """The words of a text in order; none of a null one."""
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t-\\r]+"))


def _classes(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``chars``, code points by class: each class is cut out of what the ones before left."""
    rest, names = F.coalesce(F.col(text), F.lit("")), []
    out = rows.withColumn("__rest_0", rest)
    for k, pattern in enumerate(CLASSES):
        out = out.withColumn(f"__rest_{k + 1}", F.regexp_replace(f"__rest_{k}", pattern, ""))
        out = out.withColumn(f"__class_{k}", F.length(f"__rest_{k}") - F.length(f"__rest_{k + 1}")).drop(f"__rest_{k}")
        names.append(f"__class_{k}")
    last = f"__rest_{len(CLASSES)}"
    return out.withColumn("chars", F.array(*names, F.length(last)).cast("array<bigint>")).drop(*names, last)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words that stand in a window of which there are two or more, of the words' hashes."""
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        fresh = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(fresh, none, lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda e, j: F.coalesce(e.h == F.get(ordered, j).h, F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e.at))

    def of(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.cast("int").alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(ordered, places), covered)).otherwise(none)

    # a slice of an array in memory is cheap, one of an array in a row reads it whole: the hashes are bound, not a column
    starts = lambda known: F.sequence(F.lit(1), F.size(known) - (WINDOW - 1))
    windows = lambda known: F.transform(starts(known), lambda i: F.xxhash64(F.slice(known, i, WINDOW)))
    return _let(hashes, lambda known: F.when(F.size(known) <= WINDOW, none).otherwise(_let(windows(known), of)))


def base(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base figures of ``text``, its words as ``__words`` and its ``chars`` by class.

    Windows are told apart by a 64-bit hash of their words' 64-bit hashes.
    """
    out = _classes(rows.withColumn("__words", words(text)), text)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = out.withColumn("__lines", lines)
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.col("chars")[3],
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeated(F.transform("__words", lambda w: F.xxhash64(w))),
    })
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__lines")


def references(docs: DataFrame) -> DataFrame:
    """A row for each language of ``docs(text, lang)``: its common words, both histograms, its words.

    ``(lang, ref_words, ref_counts, ref_chars, ref_total)``; documents without a language are
    one of their own, ''.  Counts are of all documents; of equally common words the smaller is taken.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    own = docs.select(lang, "text")
    counts = own.select("lang", F.explode(words()).alias("word")).where(F.octet_length("word") <= WORD_BYTES).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("k", rank).where(F.col("k") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))  # COMMON a language
    sizes = _classes(own.withColumn("__n", F.size(words())), "text")
    sums = [F.sum(F.col("chars")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    total = sizes.groupBy("lang").agg(F.sum("__n").alias("ref_total"), *sums)
    chars = F.array(*[F.col(f"c{k}") for k in range(len(CLASSES) + 1)]).alias("ref_chars")
    return total.join(top, "lang", "left").select("lang", F.col("top.word").alias("ref_words"), F.col("top.n").alias("ref_counts"), chars, "ref_total")


def divergence(own: Column, own_total: Column, other: Column, other_total: Column) -> Column:
    """The squared Jensen-Shannon distance, from 0 to 1, of two histograms: arrays of counts of the same bins."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    both = F.zip_with(own, other, lambda a, b: F.struct((a / own_total).alias("p"), (b / other_total).alias("q")))
    parts = F.transform(both, lambda x: (term(x.p, x.q) + term(x.q, x.p)) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def with_rest(counts: Column, total: Column) -> Column:
    """A histogram with one more bin: what of ``total`` is in none."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))


def assess(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rules' figures and verdict for each row of ``docs(doc_id, text, lang)``.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_divergence, word_divergence, char_failed, word_failed, kept)``.  A divergence is null
    where the document is too short or its language's reference too small to compare, and then
    fails nothing.  Null and empty texts have no words and fail the base rules; null languages
    are one language; repeated rows are judged each; other columns are not read, so their names
    do not matter; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    scratch = Scratch(spark)
    known = scratch.table(references(own), "references")
    known = known.where(F.col("ref_total") >= MIN_REFERENCE)
    languages = known.count()
    common = sorted({w for r in known.select("ref_words").collect() for w in r.ref_words or ()}) if languages <= MOST_LISTED else []
    known = F.broadcast(known) if languages <= MOST_BROADCAST else known
    rows = base(own.join(known, "lang", "left"))
    long_enough = (F.col("n_words") >= MIN_WORDS) & F.col("ref_words").isNotNull()
    # words that are common in no language are told by one look into a set; the others are looked for in their language's
    near = F.filter("__words", lambda w: w.isin(common)) if common else F.col("__words")
    hits = F.filter(F.transform(near, lambda w: F.array_position(F.col("ref_words"), w)), lambda k: k > 0)
    counts = _let(hits, lambda found: F.transform("ref_words", lambda w, j: (F.size(found) - F.size(F.array_remove(found, (j + 1).cast("long")))).cast("long")))
    rows = rows.withColumns({"__counts": F.when(long_enough, counts), "n_chars": F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)})
    words_far = divergence(with_rest(F.col("__counts"), F.col("n_words")), F.col("n_words"), with_rest(F.col("ref_counts"), F.col("ref_total")), F.col("ref_total"))
    ref_chars = F.aggregate("ref_chars", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("__ref_chars", ref_chars)
    chars_far = divergence(F.col("chars"), F.col("n_chars"), F.col("ref_chars"), F.col("__ref_chars"))
    rows = rows.withColumns({
        "word_divergence": F.when(long_enough, words_far),
        "char_divergence": F.when((F.col("n_chars") >= MIN_CHARS) & F.col("ref_chars").isNotNull(), chars_far),
    })
    allowed = WORD_LIMIT + WORD_SLACK * F.size("ref_words") / (8 * math.log(2) * F.col("n_words"))
    rows = rows.withColumns({
        "word_failed": F.coalesce(F.col("word_divergence") > allowed, F.lit(False)),
        "char_failed": F.coalesce(F.col("char_divergence") > CHAR_LIMIT + CHAR_SLACK / F.col("n_chars"), F.lit(False)),
    })
    kept = ~F.col("base_failed") & ~F.col("word_failed") & ~F.col("char_failed")
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_divergence", "word_divergence", "char_failed", "word_failed", kept.alias("kept"))
    # written, so that a filter of the result is not pushed into the figures and computes them over and over
    return scratch.table(out, "assessed")


def sql(table: str = "documents") -> str:
    """The same as DuckDB SQL, without the divergences."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    cut, ctes = "body", [f"d as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as body from {table})"]
    columns = []
    for k, pattern in enumerate(CLASSES):
        after = f"regexp_replace({cut}, '{pattern}', '', 'g')"
        ctes.append(f"cut_{k} as (select *, {after} as rest_{k} from {'d' if k == 0 else f'cut_{k - 1}'})")
        columns.append(f"length({cut}) - length(rest_{k})")
        cut = f"rest_{k}"
    n = len(CLASSES) + 1
    chars = ", ".join(f"cast({c} as bigint) as c{k}" for k, c in enumerate([*columns, f"length({cut})"]))
    last = f"cut_{len(CLASSES) - 1}"
    far = lambda p, q: f"case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end"
    each = lambda own, total, other, whole: "(" + " + ".join(f"({far(f'({a} / {total})', f'({b} / {whole})')} + {far(f'({b} / {whole})', f'({a} / {total})')}) / 2" for a, b in zip(own, other, strict=True)) + ")"
    sums = lambda p: "(" + " + ".join(f"{p}c{k}" for k in range(n)) + ")"
    ctes += [
        f"chars as (select r, lang, {chars} from {last})",
        f"w as (select r, lang, unnest(regexp_extract_all(body, {word})) as word, generate_subscripts(regexp_extract_all(body, {word}), 1) as pos from d)",
        "per as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r)",
        f"win as (select r, pos, string_agg(word, ' ') over (partition by r order by pos rows between current row and {WINDOW - 1} following) as win, count(*) over (partition by r order by pos rows between current row and {WINDOW - 1} following) as size from w)",
        f"again as (select r, pos from (select r, pos, count(*) over (partition by r, win) as times from win where size = {WINDOW}) where times > 1)",
        f"reps as (select r, count(distinct pos + j) as n_repeat_words from again, range({WINDOW}) x(j) group by r)",
        "lines as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(body, chr(10))) as line from d) where regexp_matches(line, '[^ \\t-\\r]') group by r)",
        f"common as (select * from (select lang, word, n, row_number() over (partition by lang order by n desc, word) as k from (select lang, word, count(*) as n from w where strlen(word) <= {WORD_BYTES} group by all)) where k <= {COMMON})",
        "total as (select lang, cast(sum(coalesce(n_words, 0)) as double) as tw, " + ", ".join(f"cast(sum(c{k}) as double) as t{k}" for k in range(n)) + f" from chars left join per using (r) group by lang having tw >= {MIN_REFERENCE})",
        "hits as (select w.r, k, count(*) as m from w join common c on c.lang = w.lang and c.word = w.word group by all)",
        "far as (select p.r, sum(" + f"({far('p', 'q')} + {far('q', 'p')}) / 2) as wd, count(*) as bins from (select per.r, c.k, coalesce(h.m, 0) / cast(per.n_words as double) as p, c.n / t.tw as q from per join d using (r) join total t using (lang) join common c using (lang) left join hits h on h.r = per.r and h.k = c.k"
        " union all select per.r, null, (per.n_words - coalesce(hm, 0)) / cast(per.n_words as double), (t.tw - cn) / t.tw from per join d using (r) join total t using (lang) join (select lang, sum(n) as cn from common group by lang) using (lang) left join (select r, sum(m) as hm from hits group by r) h using (r)) p group by p.r)",
        f"cfar as (select r, {sums('')} as nc, {each([f'c{k}' for k in range(n)], 'cast(' + sums('') + ' as double)', [f't{k}' for k in range(n)], '(' + ' + '.join(f't{k}' for k in range(n)) + ')')} as cd from chars join total using (lang) where {sums('')} >= {MIN_CHARS})",
        f"""figures as (select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, chars.c3 as n_symbols,
            cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
            coalesce(cd > {CHAR_LIMIT!r}::double + {CHAR_SLACK!r}::double / nc, false) as char_failed,
            coalesce(n_words >= {MIN_WORDS} and wd > {WORD_LIMIT!r}::double + {WORD_SLACK!r}::double * (bins - 1) / ({8 * math.log(2)!r}::double * n_words), false) as word_failed
          from d join chars using (r) left join per using (r) left join reps using (r) left join lines using (r) left join far using (r) left join cfar using (r))""",
        f"judged as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from figures)",
    ]
    return "with " + ",\n".join(ctes) + "\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_failed, word_failed, not (base_failed or char_failed or word_failed) as kept from judged"
