"""Secret scans with multipart credential linking.

Strong patterns (an assignment to a secret's name, an access identifier, a long
hexadecimal run) count by themselves. Weak candidates do not: a bare random-looking
run, a user or client name that is assigned, an address of a service. An interval join
within a text links secrets with identifiers and endpoints at most ``SCOPE`` code
points apart, and a weak candidate is reported only if a complementary part is there:
a secret needs an identifier or an endpoint, either of those a secret.

Spans are half-open and in code points. Null and empty texts have none. Rows with
equal texts have equal spans; ids, null or repeated, play no part in the search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.spans import binned, digest, located, per_document, without_overlaps
from shelfmark.llm.tables import materialise

SCOPE = 200
BASE = ["assign", "access", "hex"]
WEAK = ["secret", "identity", "endpoint"]

# The base patterns. A run of at least 16 (or 4 + 14) is the same as a run of any length kept if it is that long.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]{14,}+", 0),
    "hex": (r"[0-9a-f]{16,}+", 0),
}
WEAK_PATTERNS = {
    "secret": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0),
    "identity": (r"""(?i:user|username|login|client_?id|key_?id|account|email)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", 1),
    "endpoint": (r"""(?:[a-z][a-z0-9+]{1,15}://[^\s"'<>,;]{4,}|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5})""", 0),
}
#: Longest and shortest group of an assignment that counts.
ASSIGNED = 12


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, kind, start, end) of what counts by itself."""
    return located(docs, text_col, PATTERNS).where((F.col("kind") != "assign") | (F.length("inner") >= ASSIGNED)).select("text_key", "kind", "start", "end")


def linked_spans(docs: DataFrame, base: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(text_key, kind, start, end) of the weak candidates with a complementary part in scope."""
    weak = located(docs, text_col, WEAK_PATTERNS)
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]")
    weak = weak.where((F.col("kind") != "secret") | mixed).select("text_key", "kind", "start", "end")
    weak = materialise(without_overlaps(weak, base))
    # a service's address holds runs that look random; it is one part, not two
    weak = without_overlaps(weak.where("kind = 'secret'"), weak.where("kind = 'endpoint'")).unionByName(weak.where("kind <> 'secret'"))
    parts = base.unionByName(weak).withColumn("strong", F.col("kind").isin(BASE))
    secrets = parts.where(F.col("kind").isin("assign", "hex", "secret")).select(
        "text_key", "start", "end", F.col("kind").alias("s_kind"), F.col("strong").alias("s_strong"))
    keys = parts.where(F.col("kind").isin("access", "identity", "endpoint"))
    near = binned(keys, scope, scope).join(
        binned(secrets, scope).select("text_key", "bin", "s_kind", "s_strong", F.col("start").alias("s_start"), F.col("end").alias("s_end")), ["text_key", "bin"])
    near = near.where((F.col("s_start") - F.col("end") <= scope) & (F.col("start") - F.col("s_end") <= scope))
    one = near.where("not strong").select("text_key", "kind", "start", "end")
    other = near.where("not s_strong").select("text_key", F.col("s_kind").alias("kind"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    return one.unionByName(other).distinct()


def secret_spans(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(text_key, kind, start, end) of all reported spans in all different texts."""
    base = materialise(base_spans(docs, text_col))
    return base.unionByName(linked_spans(docs, base, text_col, scope))


def secrets_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per document."""
    found = materialise(digest(secret_spans(docs, text_col, scope), BASE + WEAK, BASE, by_kind=False))
    return per_document(docs, id_col, text_col, found, BASE)
