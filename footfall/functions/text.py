"""Small text rules shared by the other functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall import fixed_values as fv


def literals(rows: Sequence, names: Sequence[str] = ()) -> Column:
    """A constant array of strings, or of structs with ``names``, as one parsed expression."""
    quote = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    if not names:
        return F.expr("array(" + ",".join(map(quote, rows)) + ")")
    struct = lambda row: "named_struct(" + ",".join(f"'{n}',{quote(v)}" for n, v in zip(names, row)) + ")"
    return F.expr("array(" + ",".join(map(struct, rows)) + ")")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written and computed once.

    Catalyst copies an expression into every place that refers to it when it moves filters below a
    projection; binding it to a lambda variable keeps long rules over derived columns small.
    """
    return F.transform(F.array(value), body)[0]


def clean_text(c: Column) -> Column:
    """Drop tags, then outer white space. Most texts have no tag and are spared the pattern."""
    untagged = F.when(c.contains("<"), F.regexp_replace(c, r"<[^>]*>", "")).otherwise(c)
    return F.btrim(untagged, F.lit(" \t\n\x0b\f\r"))


def blank(c: Column) -> Column:
    """True for the values the reference rules treat as missing: NULL, '' and '0'."""
    return c.isNull() | c.isin("", "0")


def clean_event_name(c: Column, length: int | None = None) -> Column:
    """Letters, digits and underscores only, at most ``length`` characters if given; NULL when nothing is left."""
    words = F.regexp_replace(F.trim(c), "(?i)[^a-z0-9_]+", "_")
    name = F.regexp_replace(words, "^_+|_+$", "")
    if length is not None:
        name = F.substring(name, 1, length)
    return F.when(~blank(name), name)


def with_clean_props(df, props: str, out: str, max_keys: int | None = None):
    """Scalar properties among all or the first ``max_keys`` named keys, as JSON text; NULL when none is left.

    Values are read as VARIANT, so a number stays a number and a string stays a string. Every named
    key takes a place even if its value is then dropped. The steps are separate
    columns, so each is evaluated once per row.
    """
    pairs = F.map_entries(F.from_json(F.col(props), "map<string,variant>"))
    named = F.filter(
        F.transform(
            pairs,
            lambda e: F.struct(
                clean_text(e["key"]).alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("kind")
            ),
        ),
        lambda e: ~blank(e["key"]),
    )
    scalar = lambda e: e["kind"].isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | e["kind"].startswith("DECIMAL")
    first = F.filter(named if max_keys is None else F.slice(named, 1, max_keys), scalar)
    texts = F.transform(
        F.col("_kept"),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(e["kind"] == "STRING", clean_text(F.variant_get(e["value"], "$", "string"))).alias("text"),
            F.when(e["kind"] != "STRING", e["value"]).alias("number"),
        ),
    )
    # cleaning can make two keys equal: the later one wins
    last = F.filter(
        F.col("_text"),
        lambda e, i: ~F.exists(F.slice(F.col("_text"), i + 2, F.size("_text")), lambda later: later["key"] == e["key"]),
    )
    plain = lambda c: ~c.rlike(r'["\\\x00-\x1f]')
    quoted = lambda c: F.when(plain(c), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(
        F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    )
    members = F.transform(
        F.col("_last"),
        lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["text"].isNotNull(), quoted(e["text"])).otherwise(F.to_json(e["number"]))),
    )
    return (
        df.withColumn("_kept", first)
        .withColumn("_text", texts)
        .withColumn("_last", last)
        .withColumn(out, F.when(F.size("_last") > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))))
        .drop("_kept", "_text", "_last")
    )


def match_any_wildcard(c: Column, patterns: list[str]) -> Column:
    """Anchored, case-insensitive match of any pattern, where only ``*`` is special."""
    given = [p.strip() for p in patterns if p.strip()]
    if not given:
        return F.lit(False)
    bodies = ["".join(".*" if ch == "*" else _literal(ch) for ch in p) for p in given]
    return F.coalesce(c.rlike("(?i)^(?:" + "|".join(bodies) + ")$"), F.lit(False))


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "/_-" else "\\" + ch


def classify_clicks(clicks, site_host: str, href: str = "href", kind: str = "kind"):
    """Event name and target of each click: a download, an outbound link or a form submission.

    ``kind`` is ``link`` or ``form``; rows that are none of the three get a NULL name.
    """
    url = F.col(href)
    ending = F.lower(F.regexp_extract(url, rf"(?i)\.({fv.DOWNLOAD_ENDINGS})$", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    link = F.col(kind) == "link"
    download = link & (ending != "")
    outbound = link & (ending == "") & (host != "") & (host != site_host.lower())
    return clicks.withColumns(
        {
            "event_name": F.when(download, "File_Download")
            .when(outbound, "Outbound_Link")
            .when(F.col(kind) == "form", "Form_Submit"),
            "target": F.when(download | outbound, url).when(
                F.col(kind) == "form", F.substring_index(F.coalesce(url, F.lit("")), "?", 1)
            ),
            "detail": F.when(download, ending).when(outbound, host),
        }
    )
