"""Secret scan with multipart credential linking, on DataFrame functions only.

Strong spans (assignments, access identifiers, long hex runs) are found on their own.
Weak candidates (temporary and client identifiers, users and passwords in addresses,
endpoints, mixed base64 keys, shorter hex runs) mean nothing alone; they are reported
only where complementary parts of a credential, an access identifier, a secret and an
endpoint, lie within one scope of the text: all three, or one with a strong part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of the scan: kind, pattern, rank, role.  Spans are whole matches.
STRONG = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 0, "secret"),
    ("access", r"AKIA[A-Z0-9]{12,}", 1, "access"),
    ("hex", r"[0-9a-f]{32,}", 2, "secret"),
]
WEAK = [
    ("endpoint", r"(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 3, "endpoint"),
    ("weak_key", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 4, "secret"),
    ("weak_hex", r"(?<![0-9A-Za-z])[0-9a-f]{16,31}(?![0-9A-Za-z])", 5, "secret"),
    ("temp_access", r"(?<![A-Z0-9])A(?:SI|RO|GP|ID)A[A-Z0-9]{12,}", 6, "access"),
    ("client_id", r"(?i:client_?id|app_?id|account_?id|key_?id|user(?:_?name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{4,}", 7, "access"),
    ("url_user", r"(?<=://)[A-Za-z0-9._%+-]{2,64}(?=:[^\s/@:]{4,128}@)", 8, "access"),
    ("url_pass", r"(?<=://[A-Za-z0-9._%+-]{2,64}:)[^\s/@:]{4,128}(?=@)", 9, "secret"),
]
MIN_ASSIGNED = 8
#: A scope reaches this many characters from a part to its complement.
SCOPE = 400


def _pieces(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """All leftmost matches, with the text between them: (rank, k, gap, width, value) lengths."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    if kind == "assign":
        value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length)
        whole = F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    else:
        whole = F.transform(whole, lambda w: F.struct(w.alias("w"), F.lit(MIN_ASSIGNED).alias("v")))
    between = F.transform(F.split(text, pattern, -1), F.length)
    # There is one piece more than there are matches, the last of which has no width.
    cut = F.filter(F.zip_with(between, whole, lambda g, m: F.struct(g.alias("g"), m["w"].alias("w"), m["v"].alias("v"))), lambda x: x["w"].isNotNull())
    return F.transform(cut, lambda x, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"), x["g"].alias("gap"), x["w"].alias("width"), x["v"].alias("value")))


def scan_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, start, rank, end, kind, role, weak) for every part of a credential.

    Null texts count as empty.  ``row_key`` tells rows of one id and different texts
    apart; repeated rows share it and give their parts once.  Matches leave the text as
    lengths; their places are running sums, so the work grows with the matches.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A cheap look tells most texts from those that can match.
    hexes, address = text.rlike("[0-9a-f]{16}"), text.contains("://")
    login = address & text.contains("@")
    may = {"access": text.contains("AKIA"), "endpoint": address, "hex": hexes, "weak_hex": hexes, "url_user": login, "url_pass": login}
    found = [F.when(may.get(kind, text.rlike(pattern)), _pieces(text, kind, pattern, rank)) for kind, pattern, rank, _ in [*STRONG, *WEAK]]
    found = F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))
    parts = rows.select("id", F.xxhash64("id", "text").alias("row_key"), found.alias("found"))
    # Copies of a row give their parts once in each task, and then once in all, before
    # the parts of a document come together: a row may be any share of all.
    parts = parts.select("id", "row_key", F.inline("found")).distinct()
    run = Window.partitionBy("id", "row_key", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(run).cast("int")).where(F.col("value") >= MIN_ASSIGNED)
    name = lambda at: F.element_at(F.array(*[F.lit(k[at]) for k in [*STRONG, *WEAK]]), F.col("rank") + 1)
    return parts.select("id", "row_key", (F.col("end") - F.col("width")).alias("start"), "rank", "end", name(0).alias("kind"), name(3).alias("role"), (F.col("rank") >= len(STRONG)).alias("weak"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of each part with the nearest complementary parts in its scope.

    The join runs as one sweep in text order (start, rank, end) over each document: of
    every role the earlier part that ends last, and the later one that starts first,
    are the nearest on either side, however spans nest, touch or overlap.  They decide
    whether an interval of ``scope`` characters around a part holds that role.  No pairs
    of parts are made; a part links with the nearer of the two, the earlier on a tie.

    Adds access_at, secret_at and endpoint_at, the starts of the linked parts.  A weak
    part stays only if two other roles lie in its scope, or one that is strong, and if
    no strong part overlaps it.  So an identifier and an endpoint alone, or a weak key
    and its identifier, say nothing.
    """
    doc = Window.partitionBy("id", "row_key")
    # What comes after is swept backwards: a running frame, not one anew for each row.
    before = doc.orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = doc.orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(~F.col("weak"), F.col("end")), F.when(~F.col("weak"), F.col("start"))
    cols, roles = {"sure_to": F.max(sure[0]).over(before), "sure_from": F.min(sure[1]).over(after)}, ("access", "secret", "endpoint")
    for role in roles:
        for label, test in ((role, F.col("role") == role), (f"{role}_sure", (F.col("role") == role) & ~F.col("weak"))):
            cols[f"p_{label}"] = F.max(F.when(test, F.struct("end", "start"))).over(before)
            cols[f"n_{label}"] = F.min(F.when(test, F.struct("start", "end"))).over(after)
    swept = parts.withColumns(cols)

    def near(label: str) -> Column:
        gap_p, gap_n = F.col("start") - F.col(f"p_{label}.end"), F.col(f"n_{label}.start") - F.col("end")
        # Overlapping parts have a gap of 0; without a part there is no gap at all.
        p, n = F.when(gap_p <= scope, F.greatest(gap_p, F.lit(0))), F.when(gap_n <= scope, F.greatest(gap_n, F.lit(0)))
        at = F.when(p.isNotNull() & (n.isNull() | (p <= n)), F.col(f"p_{label}.start")).when(n.isNotNull(), F.col(f"n_{label}.start"))
        return F.when(F.col("role") != label.removesuffix("_sure"), at)

    inside = (F.coalesce("sure_to", F.lit(-1)) > F.col("start")) | (F.coalesce("sure_from", F.col("end")) < F.col("end"))
    kept = swept.where(~F.col("weak") | ~inside).select(
        "id", "row_key", "start", "rank", "end", "kind", "role", "weak",
        *[near(r).alias(f"{r}_at") for r in roles],
        *[near(f"{r}_sure").isNotNull().alias(f"{r}_sure") for r in roles],
    )
    count = sum(F.col(f"{r}_at").isNotNull().cast("int") for r in roles)
    sure = F.col("access_sure") | F.col("secret_sure") | F.col("endpoint_sure")
    return kept.where(~F.col("weak") | (count >= 2) | sure).drop(*[f"{r}_sure" for r in roles])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: id, spans (array by start, then kind).

    Each span has start, end (code points, end exclusive), kind, role, weak and the
    starts of the linked parts.  Empty, blank and null texts have no spans; repeated
    rows each get theirs; a null id is kept; extra columns of ``docs`` are not read; an
    empty table gives none.  Work within a document grows with its matches.
    """
    linked = link_parts(scan_parts(docs, id_col, text_col), scope)
    spans = linked.groupBy(F.col("id").alias("span_id"), F.col("row_key").alias("span_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "role", "weak", "access_at", "secret_at", "endpoint_at"))).alias("spans")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    same = F.col("id").eqNullSafe(F.col("span_id")) & (F.col("row_key") == F.col("span_key"))
    return rows.join(spans, same, "left").select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans, one row per document."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["weak"])).cast("long").alias("n_weak"),
    )
