"""Secret scan with corpus-wide ownership frequency (operator 7, DataFrame and SQL functions only).

Three kinds of candidates are matched in every whole text. Their values are hashed and counted
over the corpus by distinct repositories and owners (columns of the table). A value that many
owners hold is an *example* (documentation, copied snippets); one held by few owners that looks
random is *live*; the rest is *plain*. The method adds the spans of kind ``copy``: bare
occurrences (no keyword beside them, no base span over them) of a value that some text of the
corpus uses as a credential. Bare values are the maximal runs of the alphabet of values, and the
parts of a run between its ``=`` (``name=value``; padding stays), of six or more characters. Final
dots belong to no bare value, and values that differ only in final dots are one.

Texts never leave their scan: only spans and hashes are shuffled, and copies of a text share one
row of spans. A Bloom filter of the known values' hashes, of bounded size, drops nearly all other words
in the scan; what passes meets the table of known values in a salted join.

Cases: a null text is empty; a null owner or repository counts as one of its own; repeated rows
give repeated results; a value that a third of all rows hold is aggregated per (value, owner,
repository) before it meets others; empty tables give empty results. Offsets are code points,
ends exclusive. Long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitio.llm.common import salted_join, stored


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed values of the contract: kinds in order, pattern, group of the value, least length of it.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(_either(k) for k in KEYWORDS) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
#: What is searched: runs of the least length at once. The runs are maximal, so the spans are those of
#: the patterns above; an assignment's short value takes part, because it uses up text.
SEARCH = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: Matches whose lengths are summed at a time.
STEP = 64
#: What can end a search early: texts without a match of this have no candidate of the kind.
GUARDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Bare values: whole runs, and parts of runs that hold a "=" inside (second pattern: which texts have such).
RUN = "[A-Za-z0-9+/_.=-]{6,}"
PART, PART_GUARD = "[A-Za-z0-9+/_.-]+=*", "[A-Za-z0-9+/_.-]=+[A-Za-z0-9+/_.-]"
LEAST_COPY = 6
#: A Bloom filter has 16 to 32 bits a key, at least and at most so many (8 MB), and PROBES bits are set per key. It
#: moves work, not results: beyond, more rows that match nothing reach the join behind it.
MAP_BITS = (1 << 16, 1 << 26)
PROBES = 4
EXAMPLE_OWNERS = 3
LIVE_SYMBOLS = 8
PLACE = ("start", "no", "kind", "end", "value")
SPAN = "array<struct<start:int,no:int,kind:string,end:int,value:string>>"


def _spans(df: DataFrame, kind: str, no: int, pattern: str, guard: str, group: int, least: int) -> DataFrame:
    """Add the array column ``kind``: matches with code point bounds, from the lengths of the
    matches and of the pieces between them."""
    text, pat = F.col("_text"), F.lit(pattern)
    found = F.col("_text").rlike(guard)
    df = df.withColumn("_h", F.when(found, F.regexp_extract_all(text, pat, F.lit(0)))) \
        .withColumn("_p", F.when(F.size("_h") > 0, F.split(text, pattern, -1))) \
        .withColumn("_v", F.when(F.size("_h") > 0, F.regexp_extract_all(text, pat, F.lit(group))))
    # where a match starts: the lengths of all pieces and matches before it, summed in steps of STEP so
    # that no array grows match by match. transform(array(x), y -> ...)[0] binds y to x, once per text
    lengths = "transform(x.h, (m, i) -> length(x.p[i]) + length(m))"
    steps = f"""aggregate(sequence(0, (size(l) - 1) div {STEP}), array(0), (a, b) ->
        concat(a, array(element_at(a, -1) + aggregate(slice(l, int(b * {STEP} + 1), {STEP}), 0, (t, v) -> t + v))))"""
    starts = f"""transform(l, (m, i) -> s[int(i div {STEP})] + length(x.p[i])
        + aggregate(slice(l, int(i div {STEP}) * {STEP} + 1, i % {STEP}), 0, (t, v) -> t + v))"""
    spans = F.expr(f"""transform(array(named_struct('h', _h, 'p', _p, 'v', _v)), x ->
        transform(array({lengths}), l -> transform(array({steps}), s -> transform(array({starts}), at ->
            filter(transform(x.h, (m, i) -> named_struct('start', at[i], 'no', {no}, 'kind', '{kind}',
                                                         'end', at[i] + length(m), 'value', x.v[i])),
                   c -> length(c.value) >= {least})
        )[0])[0])[0])[0]""")
    return df.withColumn(kind, F.when(F.size("_h") > 0, spans).otherwise(F.array().cast(SPAN))).drop("_h", "_p", "_v")


def candidates(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` plus assign, access, hex (base spans) and base (all of them in order)."""
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for no, (kind, _, group, least) in enumerate(KINDS):
        df = _spans(df, kind, no, SEARCH[kind], GUARDS[kind], group, least)
    return df.withColumn("base", F.expr("array_sort(concat(assign, access, hex))")).drop("_text")


def _hash(value: Column) -> Column:
    return F.sha2(F.rtrim(value, F.lit(".")), 256)


def in_bloom(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for membership in a stored table of distinct keys: true for each of them and for about one
    other in 400. The filter is a scalar subquery: one array of at most MAP_BITS[1] bits."""
    bits = MAP_BITS[0]
    while bits < min(16 * keys.count(), MAP_BITS[1]):
        bits *= 2

    def slot(value: Column, probe: int) -> Column:
        return F.pmod(F.xxhash64(value, F.lit(probe)), F.lit(bits))

    slots = F.explode(F.array(*[slot(F.col(column), i) for i in range(PROBES)]))
    words = keys.select(slots.alias("_slot")) \
        .select(F.expr("_slot div 64").alias("at"), F.expr("shiftleft(1L, cast(_slot % 64 as int))").alias("word"))
    zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
    words = words.unionByName(zero).groupBy("at").agg(F.bit_or("word").alias("word"))
    array = words.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s")).select("s.word").scalar()

    def test(value: Column) -> Column:
        out = F.lit(True)
        for i in range(PROBES):
            at = slot(value, i)
            out &= F.getbit(F.element_at(array, F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1
        return out

    return test


def bare_values(docs: DataFrame, text_col: str, known: DataFrame) -> DataFrame:
    """(tk, start, no, kind, end, value, vh): runs, and parts of runs, whose hash is in ``known`` (vh)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.md5(text).alias("tk"), text.alias("_text"))
    df = _spans(df, "run", len(KINDS), RUN, RUN, 0, LEAST_COPY)
    df = _spans(df, "part", len(KINDS), PART, PART_GUARD, 0, LEAST_COPY)
    value = F.rtrim("s.value", F.lit("."))
    rows = df.select("tk", F.explode(F.concat("run", "part")).alias("s")) \
        .select("tk", "s.start", "s.no", F.lit("copy").alias("kind"), (F.col("s.start") + F.length(value)).alias("end"),
                value.alias("value")).where(F.length("value") >= LEAST_COPY).withColumn("vh", _hash(F.col("value")))
    rows = rows.where(in_bloom(known, "vh")(F.col("vh"))).distinct()
    return salted_join(rows, known, ["vh"], F.col("tk"), "inner").select("tk", *PLACE, "vh")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """``spans`` but for copies that overlap a base span of their text: no base span that starts before a
    copy or with it may reach over its start, and none that starts later may lie before its end."""
    base = F.col("no") < len(KINDS)
    before = Window.partitionBy("tk").orderBy("start", "no")
    after = Window.partitionBy("tk").orderBy(F.desc("start"), F.desc("no"))
    return spans.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("_next", F.min(F.when(base, F.col("start"))).over(after.rowsBetween(Window.unboundedPreceding, 0))) \
        .where(base | ((F.coalesce("_reach", "start") <= F.col("start")) & (F.coalesce("_next", "end") >= F.col("end")))) \
        .drop("_reach", "_next")


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",),
         repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: id, tk (MD5 of the text), the counts, digest and joined spans of
    the contract, n_live / n_example, and ``found``: the spans with value, owners and verdict."""
    owner = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in owner_cols]))
    repo = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in repo_cols]))
    keep = [F.col(id_col).alias("_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tk"),
            owner.alias("owner"), repo.alias("repo")]
    seen = stored(candidates(docs, keep, text_col), "secret-candidates")
    base = seen.where("size(base) > 0").groupBy("tk").agg(F.first("base").alias("base")) \
        .select("tk", F.explode("base").alias("s")).select("tk", *[f"s.{c}" for c in PLACE]).withColumn("vh", _hash(F.col("value")))
    base = stored(base, "secret-base")
    known = stored(base.where(F.length(F.rtrim("value", F.lit("."))) >= LEAST_COPY).select("vh").distinct(), "secret-known")
    one = stored(without_overlaps(base.unionByName(bare_values(docs, text_col, known))), "secret-spans")
    texts = stored(one.groupBy("tk").agg(F.collect_set("vh").alias("vhs")), "secret-texts")
    hit = in_bloom(texts, "tk")(F.col("tk"))
    holders = seen.where(hit).select("tk", "owner", "repo").distinct()
    uses = salted_join(holders, texts, ["tk"], F.xxhash64("owner", "repo"), "inner") \
        .select("owner", "repo", F.explode("vhs").alias("vh")).distinct()
    owners = uses.groupBy("vh").agg(F.countDistinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_repos"))
    one = salted_join(one, owners, ["vh"], F.col("tk"), "inner")
    look = (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_SYMBOLS) & F.col("value").rlike("[0-9]")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(look, "live").otherwise("plain")
    found = one.withColumn("verdict", verdict).groupBy("tk").agg(F.array_sort(F.collect_list(F.struct(
        *PLACE, "n_owners", "n_repos", "verdict"))).alias("found"))
    rows = seen.select("_id", "tk", "base", hit.alias("_hit"),
                       *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in KINDS])
    none = found.schema["found"].dataType
    with_hits = salted_join(rows.where("_hit"), found, ["tk"], F.col("_id"), "left")
    without = rows.where("not _hit").withColumn("found", F.lit(None).cast(none))
    out = with_hits.unionByName(without).withColumn("found", F.coalesce("found", F.array().cast(none)))
    return out.select(
        F.col("_id").alias(id_col), "tk", "n_assign", "n_access", "n_hex",
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"),
        *[F.expr(f"cast(size(filter(found, s -> s.verdict = '{v}')) as bigint)").alias(f"n_{v}")
          for v in ("live", "example")], "found")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with the values of live credentials replaced by ``mark``; everything else unchanged.

    Rows without live credentials keep their text as it is; only texts that hold one (and about one other
    in 400) are shuffled.
    """
    live = stored(scan(docs, id_col, text_col, **options).where("n_live > 0")
                  .groupBy("tk").agg(F.first("found").alias("found")), "secret-live")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    might = in_bloom(live, "tk")
    rows = docs.select(F.md5(text).alias("tk"), might(F.md5(text)).alias("might"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hot = salted_join(rows.where("might").withColumn("spread", F.xxhash64(f"row.`{id_col}`")), live, ["tk"], F.col("spread"))
    clean = F.expr(f"""aggregate(filter(found, s -> s.verdict = 'live'), named_struct('p', 0, 'out', ''),
        (a, s) -> CASE WHEN s.end <= a.p THEN a ELSE named_struct('p', s.end, 'out', concat(a.out,
            substring(row.`{text_col}`, a.p + 1, greatest(s.end - length(s.value) - a.p, 0)), '{mark}')) END,
        a -> concat(a.out, substring(row.`{text_col}`, a.p + 1)))""")
    hot = hot.withColumn("clean", F.when(F.col("found").isNotNull(), clean))
    out = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.coalesce("clean", value)
        elif c == n_chars:
            value = F.coalesce(F.length("clean"), value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return rows.where("not might").select("row.*").unionByName(hot.select(*out))
