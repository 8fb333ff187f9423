"""Secrets in texts, and multipart credentials linked within scopes. DataFrame functions only.

Base spans come from three patterns (assignments of secrets, access identifiers, long hexadecimal runs);
the text between the matches gives their places. Further patterns find weak candidates: other access
identifiers, unassigned 40-character keys, and endpoints. A weak candidate alone says nothing: it is
reported only if complementary parts lie in its scope, at most ``SCOPE`` characters away (an identifier
needs a secret, a key an identifier, an endpoint both). That is an interval join: parts are filed under
all cells of ``SCOPE`` characters which their scope touches, and meet by document and cell in semi-joins,
so no pairs are made and only parts are shuffled, never texts.

Places are code points, ends exclusive. Null and empty texts have no spans. Rows are told apart by id and
text; repeated rows get the same spans each, and a null id is like any other. Only the named columns are
read. A weak candidate that overlaps a base span is dropped, since that text is reported already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from blockreach.llm.common import written

SCOPE = 300
MARK = "[SECRET]"
# Matches per step of a running sum.
STEP = 256

ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# Runs that are too short never match, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
WEAK_ACCESS = r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}(?![A-Za-z0-9])"
WEAK_KEY = r"(?<![A-Za-z0-9+/=_-])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|redis|amqps?|postgres(?:ql)?|mongodb(?:\+srv)?)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"

KINDS = ("assign", "access", "hex", "weak_access", "weak_key", "endpoint")
BASE, WEAK = range(3), range(3, 6)
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)
SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of a non-empty array of integers, in steps so that long arrays stay cheap."""
    none = F.array().cast("array<int>")

    def sums(part: Column) -> Column:
        return F.aggregate(part, none, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))

    def joined(all_values: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), ((F.size(all_values) - 1) / STEP).cast("int")), lambda b: sums(F.slice(all_values, b * STEP + 1, F.lit(STEP))))
        return let(steps, lambda s: let(
            sums(F.concat(F.array(F.lit(0)), F.transform(s, lambda part: F.element_at(part, -1)))),
            lambda before: F.flatten(F.transform(s, lambda part, i: F.transform(part, lambda x: x + F.get(before, i)))),
        ))

    return let(values, joined)


def spans(text: Column, pattern: str, kind: int, value_length: int = 0) -> Column:
    """Places of all matches, as structs of start, kind and end; with ``value_length`` only those whose group 1 has so many characters."""
    regex = F.lit(pattern)

    def placed(ends: Column, matches: Column, values: Column) -> Column:
        # ends: of gap 0, match 0, gap 1, match 1 and so on
        found = F.transform(matches, lambda m, i: F.struct(
            F.get(ends, 2 * i).alias("start"), F.lit(kind).alias("kind"), F.get(ends, 2 * i + 1).alias("end"),
            (F.length(F.get(values, i)) if value_length else F.lit(0)).alias("value"),
        ))
        kept = F.filter(found, lambda m: m["value"] >= value_length) if value_length else found
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))

    def of_matches(matches: Column) -> Column:
        lengths = let(F.split(text, pattern, -1), lambda gaps: F.flatten(F.transform(matches, lambda m, i: F.array(F.length(F.get(gaps, i)), F.length(m)))))
        values = F.regexp_extract_all(text, regex, F.lit(1)) if value_length else F.array().cast("array<string>")
        return let(running_sums(lengths), lambda ends: let(values, lambda v: placed(ends, matches, v)))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.coalesce(F.rlike(text, regex), F.lit(False)), let(F.regexp_extract_all(text, regex, F.lit(0)), of_matches)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Base spans by place, then kind."""
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, ASSIGN_VALUE), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def weak_spans(text: Column, base: Column) -> Column:
    """Weak candidates that overlap no base span, by place, then kind."""
    found = F.concat(spans(text, WEAK_ACCESS, 3), spans(text, WEAK_KEY, 4), spans(text, ENDPOINT, 5))
    return F.array_sort(F.filter(found, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))


def candidate_key(doc_id: Column, text: Column, base: Column, weak: Column) -> Column:
    """Key of rows in which some weak candidate may have a complement; null for all others."""
    def held(kinds: tuple[int, ...]) -> Column:
        return F.exists(F.concat(base, weak), lambda s: s["kind"].isin(*kinds))

    possible = (F.size(weak) > 0) & held(SECRETS) & held(IDENTIFIERS)
    return F.when(possible, F.sha2(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), text), 256))


def linked_spans(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``key, linked``: weak candidates of ``rows (key, base, weak)`` with complementary parts in their scope."""
    parts = (
        rows.where("key is not null")
        .select("key", F.explode(F.concat("base", "weak")).alias("s"))
        .select("key", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
        .distinct()
    )
    parts = written(parts, "credential-parts")

    def filed(side: DataFrame, reach: int) -> DataFrame:
        cells = F.sequence(F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope))
        return side.withColumn("cell", F.explode(cells))

    def near(side: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        other = filed(parts.where(F.col("kind").isin(*kinds)), 0).select(F.col("key").alias("k"), F.col("cell").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"))
        apart = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
        met = filed(side, scope).join(other, (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")) & (apart <= scope), "left_semi")
        return met.drop("cell").distinct()

    identifiers = near(parts.where("kind = 3"), SECRETS)
    keys = near(parts.where("kind = 4"), IDENTIFIERS)
    endpoints = near(near(parts.where("kind = 5"), IDENTIFIERS), SECRETS)
    linked = identifiers.unionByName(keys).unionByName(endpoints)
    # The spans of one document, as many as its text holds.
    return linked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def joined_spans(all_spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row ``doc_id, base`` and ``linked`` span arrays, ``n_assign, n_access, n_hex, base_sha256`` and ``spans``."""
    found = (
        df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
        .withColumn("base", base_spans(F.col("text")))
        .withColumn("weak", weak_spans(F.col("text"), F.col("base")))
        .withColumn("key", candidate_key(F.col("doc_id"), F.col("text"), F.col("base"), F.col("weak")))
        .drop("text")
    )
    found = written(found, "secret-parts")
    linked = linked_spans(found, scope)
    none = F.array().cast(f"array<{SPAN}>")
    # Rows without candidates have a null key and stay out of the join.
    rows = (
        found.where("key is null").select("doc_id", "base", none.alias("linked"))
        .unionByName(found.where("key is not null").join(linked, "key", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked")))
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return rows.select(
        "doc_id", "base", "linked", *map(count, BASE),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def replaced(text: Column, sorted_spans: Column, mark: str = MARK) -> Column:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        # A span that begins inside the last one is swallowed by its mark.
        gap = F.when(s["start"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], gap).alias("out"))

    return F.when(F.size(sorted_spans) == 0, text).otherwise(F.aggregate(sorted_spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """All rows with their secrets replaced by ``MARK``, and ``length_col`` (if there) set to the new length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # All patterns run once; the spans are written beside the rows.
    marked = df.withColumn("__base", base_spans(text)).withColumn("__weak", weak_spans(text, F.col("__base")))
    marked = written(marked.withColumn("__key", candidate_key(F.col(id_col), text, F.col("__base"), F.col("__weak"))), "rows-with-spans")
    linked = linked_spans(marked.select(F.col("__key").alias("key"), F.col("__base").alias("base"), F.col("__weak").alias("weak")), scope)
    none = F.array().cast(f"array<{SPAN}>")
    columns = [F.col(f"`{c}`") for c in df.columns]
    plain = marked.where("__key is null").withColumn("__spans", F.col("__base"))
    joint = marked.where("__key is not null").join(linked.withColumnsRenamed({"key": "__key", "linked": "__linked"}), "__key", "left")
    joint = joint.withColumn("__spans", F.array_sort(F.concat("__base", F.coalesce("__linked", none))))
    both = plain.select(*columns, "__spans").unionByName(joint.select(*columns, "__spans"))
    out = both.withColumn(text_col, F.when(F.size("__spans") > 0, replaced(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col)))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.size("__spans") > 0, F.length(text_col).cast(dict(df.dtypes)[length_col])).otherwise(F.col(length_col)))
    return out.select(*columns)
