"""Canonical exact digests, with built-in expressions only.

The canonical text is NFC, lower case (through upper case, so that one-to-many foldings agree) and has each run of white
space as one space, none at the ends.  Its fingerprint is 128 bits of xxhash64 in hexadecimal.  Texts that share a
fingerprint are compared byte by byte; should two different canonical texts meet, a number is added to each.

NFC by expressions: texts without characters that normalisation can touch are left alone.  The others are cut into
clusters (a character and its marks); the base is decomposed and the marks are ordered by combining class and composed,
by tables that are derived from the Unicode database at plan time.  Conjoining Hangul jamo are composed by arithmetic.

Defined results: null text is empty; rows follow each other by descending doc_id (null last), rows with one doc_id by
their text; a single row is its own next row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: The first character that canonical composition can touch (the first combining mark).
FIRST_TOUCHED = 0x300
#: Leading, vowel and trailing jamo, and syllables, as insides of regex classes; the first of each, and trailing jamo with none.
_L, _V, _T, _S = (rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0xAC00, 0xD7A3)))
_FIRST_L, _FIRST_V, _NO_T, _FIRST_S, _TRAILING = 0x1100, 0x1161, 0x11A7, 0xAC00, 28
#: No character decomposes into more than so many marks and a base, so that of a class's marks no later one can join; a run of more characters is folded class by class.
JOINING, LONG_RUN = 4, 64
ROWS_PER_RANGE, COARSE = 4000, 256
#: So many repeated fingerprints (24 bytes each) are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def _spans(points: set[int]) -> str:
    """The inside of a regex class of code points."""
    spans: list[list[int]] = []
    for c in sorted(points):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


@lru_cache(1)
def _unicode() -> tuple[str, str, dict[str, str], dict[str, str], dict[str, int]]:
    """Classes of what NFC may change and of what joins a character before it; decompositions, compositions, classes."""
    changed, joins, full, pairs, classes = set(), set(), {}, {}, {}
    for c in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x30000)):
        ch = chr(c)
        if unicodedata.combining(ch):
            classes[ch] = unicodedata.combining(ch)
            joins.add(c)
        plain = unicodedata.normalize("NFD", ch)
        if plain != ch:
            full[ch] = plain
            if unicodedata.normalize("NFC", ch) != ch:
                changed.add(c)
            elif len(parts := unicodedata.decomposition(ch).split()) == 2:
                pairs[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = ch
                joins.add(int(parts[1], 16))
    return f"[{_spans(changed | joins)}{_V}{_T}]", f"[{_spans(joins)}]", full, pairs, classes


def _number(char: Column, chars: str) -> Column:
    """The place of a character in ``chars``, from one, or 0: found by hashing, through characters of a private plane."""
    private = "".join(chr(0xF0001 + k) for k in range(len(chars)))
    found = F.translate(char, chars, private)
    return F.when(found != char, F.ascii(found) - 0xF0000).otherwise(0)


def _entry(number: Column, values: list[str]) -> Column:
    """The value at a place from one, or null."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<string>"), number - 1)


def _syllables(text: Column) -> Column:
    """Leading and vowel jamo, with a trailing one or not, and open syllables with a trailing one, as one syllable each."""
    code = lambda s, k: F.ascii(F.substring(s, k, 1))
    char = lambda c: F.decode(F.unhex(F.hex(c)), "UTF-16BE")

    def compose(p: Column) -> Column:
        first, second, third = code(p, 1), code(p, 2), code(p, 3)
        trailing = F.when(third > 0, third - _NO_T).otherwise(0)
        syllable = _FIRST_S + ((first - _FIRST_L) * 21 + second - _FIRST_V) * _TRAILING + trailing
        return (
            F.when(p.rlike(rf"\A[{_L}][{_V}]"), char(syllable))
            .when(p.rlike(rf"\A[{_S}][{_T}]") & ((first - _FIRST_S) % _TRAILING == 0), char(first + second - _NO_T))
            .otherwise(p)
        )

    parts = F.regexp_extract_all(text, F.lit(rf"(?s)([{_L}][{_V}][{_T}]?|[{_S}][{_T}]|[^{_L}{_S}]+|.)"), F.lit(1))
    return F.array_join(F.transform(parts, compose), "")


def nfc(text: Column) -> Column:
    """Canonical composition of a text."""
    touched, joins, full, pairs, classes = _unicode()
    marks = "".join(classes)
    of_class = "".join(chr(0xF0001 + c) for c in classes.values())
    heads: dict[str, tuple[str, str]] = {}
    for pair, whole in pairs.items():
        seconds, wholes = heads.get(pair[0], ("", ""))
        heads[pair[0]] = (seconds + pair[1], wholes + whole)
    rank = lambda c: F.when((moved := F.translate(c, marks, of_class)) != c, F.ascii(moved) - 0xF0001).otherwise(0)
    down = lambda c: F.coalesce(_entry(_number(c, "".join(full)), list(full.values())), c)

    def up(head: Column, mark: Column) -> Column:
        """The composition of a character and a mark, or an empty string."""
        at = _number(head, "".join(heads))
        place = F.coalesce(F.instr(_entry(at, [m for m, _ in heads.values()]), mark), F.lit(0))
        return F.when(place > 0, F.substring(_entry(at, [w for _, w in heads.values()]), place, F.lit(1))).otherwise("")

    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    state = lambda out, head, tail, last: F.struct(out.alias("out"), head.alias("head"), tail.alias("tail"), last.alias("last"))
    none, zero = F.lit(""), F.lit(0)

    def step(acc: Column, m: Column) -> Column:
        free = ~m["rest"] & ((acc["tail"] == "") | ((m["cls"] > 0) & (acc["last"] < m["cls"])))
        joined = F.when((acc["head"] != "") & free, up(acc["head"], m["ch"])).otherwise("")
        return F.transform(F.array(joined), lambda j: after(acc, m, j))[0]

    def after(acc: Column, m: Column, joined: Column) -> Column:
        return (
            F.when(acc["head"] == "", state(acc["out"], m["ch"], none, zero))
            .when(joined != "", state(acc["out"], joined, acc["tail"], acc["last"]))
            .when(m["cls"] == 0, state(F.concat(acc["out"], acc["head"], acc["tail"]), m["ch"], none, zero))
            .otherwise(state(acc["out"], acc["head"], F.concat(acc["tail"], m["ch"]), m["cls"]))
        )

    mark = _spans({ord(c) for c in classes})
    item = lambda x: F.struct(x["cls"].alias("cls"), x["ch"].alias("ch"), F.lit(False).alias("rest"))

    def leading(run: Column) -> Column:
        """Marks of one class in order: one by one, but as one string from where none can join any more."""
        rest = F.struct(run[0]["cls"].alias("cls"), F.array_join(F.transform(F.slice(run, JOINING + 1, F.size(run)), lambda x: x["ch"]), "").alias("ch"), F.lit(True).alias("rest"))
        some = F.transform(F.slice(run, 1, JOINING), item)
        return F.when(F.size(run) > JOINING, F.concat(some, F.array(rest))).otherwise(some)

    def by_class(marks: Column) -> Column:
        kinds = F.array_distinct(F.transform(marks, lambda x: x["cls"]))
        return F.flatten(F.transform(kinds, lambda k: F.transform(F.array(F.filter(marks, lambda x: x["cls"] == k)), leading)[0]))

    def compose(cluster: Column) -> Column:
        plain = F.array_join(F.transform(chars(cluster), down), "")
        # Marks are ordered by class between characters of class 0, which keep their places; long runs of marks class by class.
        segments = F.regexp_extract_all(plain, F.lit(rf"(?s)([^{mark}][{mark}]*+|[{mark}]++)"), F.lit(1))
        ordered = lambda s: F.array_sort(F.transform(chars(s), lambda c, i: F.struct(rank(c).alias("cls"), i.alias("i"), c.alias("ch"))))
        items = lambda s: F.when(F.length(s) > LONG_RUN, by_class(ordered(s))).otherwise(F.transform(ordered(s), item))
        done = F.aggregate(F.flatten(F.transform(segments, items)), state(none, none, none, zero), step)
        return F.concat(done["out"], done["head"], done["tail"])

    # Jamo are neither marks nor joined by one, so that they can be composed first.
    joined_jamo = F.when(text.rlike(f"[{_V}{_T}]"), _syllables(text)).otherwise(text)
    # Runs of low characters that nothing joins stay as they are.
    low, high = rf"[\x{{0}}-\x{{{FIRST_TOUCHED - 1:X}}}]", rf"[\x{{{FIRST_TOUCHED:X}}}-\x{{10FFFF}}]"
    clusters = F.regexp_extract_all(joined_jamo, F.lit(f"(?s)((?:{low}(?!{high}))++|.{joins}*)"), F.lit(1))
    composed = F.transform(clusters, lambda c: F.when(c.rlike(touched), compose(c)).otherwise(c))
    # One range is told far faster than the class of all characters concerned, of which none comes before it.
    return F.when(text.rlike(rf"[\x{{{FIRST_TOUCHED:X}}}-\x{{10FFFF}}]") & text.rlike(touched), F.array_join(composed, "")).otherwise(text)


def canonical(text: Column) -> Column:
    """NFC, folded case and folded white space."""
    return F.btrim(F.regexp_replace(F.lower(F.upper(nfc(text))), r"(?U)\s+", " "))


def _digest(canon: Column) -> Column:
    """128 bits of a canonical text."""
    return F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second half"), canon)), 16, "0"))


def _digests(*texts: Column) -> Column:
    """An array of the digests of some texts, by one canonical expression in the plan; null for null."""
    canons = F.transform(F.array(*texts), canonical)
    return F.transform(canons, lambda c: F.when(c.isNotNull(), _digest(c)))


def _ranges(rows: DataFrame) -> Column:
    """The id range of a row, ascending: quantiles of doc_id give at most ``COARSE`` ranges, each cut evenly by its count."""
    value = "coalesce(doc_id, -9223372036854775808L)"
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.expr(value)), F.max(F.expr(value))).first()
    if n <= ROWS_PER_RANGE:
        return F.lit(0).cast("long")
    parts = min(COARSE, -(-n // ROWS_PER_RANGE))
    found = rows.agg(F.percentile_approx(F.expr(value), [i / parts for i in range(1, parts)], 50 * COARSE)).first()[0]
    cuts = sorted({c for c in found if c > low})
    fine = max(1, n // (parts * ROWS_PER_RANGE))
    lows, highs = [low, *cuts], [*cuts, high + 1]

    def case(lo: int, hi: int) -> str:
        if lo == hi:
            width = float(highs[lo] - lows[lo])
            inner = f"least(cast(floor(({value} - {lows[lo]}L) / {width!r}D * {fine}) as bigint), {fine - 1}L)" if fine > 1 else "0L"
            return f"({lo * (1 << 40)}L + {inner})"
        mid = (lo + hi) // 2
        return f"CASE WHEN {value} < {cuts[mid]}L THEN {case(lo, mid)} ELSE {case(mid + 1, hi)} END"

    return F.expr(case(0, len(cuts)))


def _below(rows: DataFrame, where: Column) -> DataFrame:
    """(above, low) for each filled range: the top doc_id of the next filled range below it, of the first after the last.

    Ranks are taken inside the at most ``COARSE`` quantile ranges, and then over one row for each of these.
    """
    tops = stage(rows.select(where.alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")), "tops")
    coarse = F.shiftright("range", 40).alias("part")
    inner = Window.partitionBy("part").orderBy(F.desc("range"))
    near = tops.select("range", "top", coarse).withColumn("low", F.lead("top").over(inner)).withColumn("end", F.lead("range").over(inner).isNull())
    heads = near.groupBy("part").agg(F.max_by("top", "range").alias("top"), F.max("range").alias("range"))
    ring = Window.orderBy(F.desc("part"))  # a row for each quantile range at most
    heads = heads.withColumn("after", F.lead(F.struct("top")).over(ring)).withColumn("first", F.first(F.struct("top")).over(ring))
    heads = heads.select("part", F.coalesce("after", "first")["top"].alias("next_top"))
    return stage(near.join(heads, "part").select(F.col("range").alias("above"), F.when(F.col("end"), F.col("next_top")).otherwise(F.col("low")).alias("low")), "below")


def with_next(rows: DataFrame) -> DataFrame:
    """The rows with ``next``, a struct of the following row in descending (doc_id, text reversed), the first after the last.

    ``rows`` has doc_id (long), text (no nulls) and others.  Rows are dealt into id ranges of a bounded size, and the top rows
    of a range once more into the range above it, where they come last; so one shuffle of the texts is enough.
    """
    columns = rows.columns
    where = _ranges(rows.select("doc_id"))
    below = _below(rows.select("doc_id"), where)
    side = F.broadcast(below) if below.count() <= BROADCAST_DIGESTS else below
    found = rows.join(side, rows.doc_id.eqNullSafe(side.low), "left").withColumn("range", where)
    # A null top is matched by null ids only, and there only is ``above`` found for them.
    places = F.array_compact(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("ghost")), F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("at"), F.lit(1).alias("ghost")))))
    dealt = found.select(*columns, F.inline(places))
    order = Window.partitionBy("at").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("ghost = 0").select(*columns, "next")


def _edited() -> Column:
    """The text with its last half replaced by the beginning of the next one."""
    return F.expr("concat(left(text, cast(length(text) - floor(length(text) / 2) as int)), left(next.text, cast(floor(length(text) / 2) as int)))")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A likeness is 1 for equal fingerprints and 0 for others, as digests are exact.
    """
    rows = with_next(_plain(docs).withColumn("digest", _digests(F.col("text"))[0])).withColumn("edited", _edited())
    cols = ["doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digest", _digests(F.col("edited"))[0].alias("edited_digest"), F.col("next.digest").alias("next_digest")]
    hashes = [F.xxhash64("text").alias("text_hash"), F.xxhash64("edited").alias("edited_hash"), F.xxhash64("next.text").alias("next_hash"), F.col("next.doc_id").alias("next_id")]
    out = stage(rows.select(*cols, *hashes), "digests")
    clashes = _clashes(out, docs)
    final = [(name, F.col(f"{name}_digest" if name else "digest")) for name in ("", "edited", "next")]
    if clashes is not None:
        for name, hash_ in (("digest", "text_hash"), ("edited_digest", "edited_hash"), ("next_digest", "next_hash")):
            side = clashes.select(F.col("digest").alias(name), F.col("hash").alias(hash_), F.concat(F.lit("-"), F.col("number").cast("string")).alias(f"{name}_n"))
            out = out.join(side, [name, hash_], "left")
        final = [(name, F.concat(c, F.coalesce(F.col(f"{name}_digest_n" if name else "digest_n"), F.lit("")))) for name, c in final]
    own, edited, following = (c for _, c in final)
    return out.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"), (own == edited).cast("double").alias("near_edited"), (own == following).cast("double").alias("near_next"))


def _clashes(out: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Byte comparison inside equal buckets: (digest, hash of the text, number) where one digest has several texts.

    Only rows whose digest repeats are read again, and their next rows where it is the edited text's digest.
    """
    both = out.select("digest").union(out.select("edited_digest"))
    repeated = stage(both.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_DIGESTS else df
    side = few(repeated)
    own = out.join(side, "digest", "left_semi").select("doc_id", F.lit(0).alias("edits"))
    edits = out.join(side.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left_semi")
    ids = own.union(edits.select(F.inline(F.array(F.struct("doc_id", F.lit(1).alias("edits")), F.struct(F.col("next_id").alias("doc_id"), F.lit(0).alias("edits"))))))
    ids = stage(ids.groupBy("doc_id").agg(F.max("edits").alias("edits")), "ids")
    ids_side = few(ids.withColumnRenamed("doc_id", "id"))
    texts = _plain(docs).join(ids_side, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "edits")
    if not edits.isEmpty():
        # The rows between are absent, which matters only to rows whose edited text is not wanted.
        with_edits = with_next(texts).select(F.explode(F.array_compact(F.array("text", F.when(F.col("edits") == 1, _edited())))).alias("text"))
    else:
        with_edits = texts.select("text")
    canon = with_edits.select(F.xxhash64("text").alias("hash"), canonical(F.col("text")).alias("canon"))
    canon = canon.withColumn("digest", _digest(F.col("canon"))).join(side, "digest", "left_semi")
    # Map-side first: a group of copies is one row for each task before it is shuffled.
    mixed = stage(canon.groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo <> hi").select("digest"), "mixed")
    if mixed.isEmpty():
        return None
    kinds = canon.join(mixed, "digest", "left_semi").distinct()
    return stage(kinds.withColumn("number", F.dense_rank().over(Window.partitionBy("digest").orderBy("canon"))).select("digest", "hash", "number").distinct(), "clashes")
