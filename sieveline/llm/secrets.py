"""Secret scans over an incremental blob ledger.

Every historical version of a file (path, version, text) is addressed by its content. The
ledger remembers which (blob, rule version) pairs have been scanned and what was found, so
only unseen pairs are scanned, each once however many paths hold the blob. Findings are then
joined back to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows
from sieveline.storage import cut


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match of pattern counts if its group has min_length characters. With until, a
    finding goes on to the end of the first match of until after it, and without one there is none.

    hints: lower-case bytes; a text that has none of them can't match (empty: always look).
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    min_length: int = 1
    hints: tuple[bytes, ...] = ()
    base: bool = False
    until: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed. hex: only whole
#: runs are matched, and those of under 24 characters fail, so the minimum stands in the pattern.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", group=2, min_length=6, hints=(b"passw", b"secret", b"token", b"api"), base=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20, hints=(b"akia",), base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", min_length=24, base=True),
)
#: Further public formats that the ledger scans for.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 2, hints=(b"private key-----",), until=r"-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 2, hints=(b"eyj",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=(b"gh",)),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=(b"xox",)),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]+@", hints=(b"://",)),
)
RULES = BASE + MORE


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start and then the rules' order; code points."""
    low, found = text.encode().lower(), []
    for order, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        if rule.until:
            found += [(a, order, rule.kind, b) for a, b in _enclosed(text, rule)]
            continue
        for m in _compiled(rule.pattern).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _enclosed(text: str, rule: Rule) -> list[tuple[int, int]]:
    """From a beginning to the first end after it, leftmost and apart; beginnings and ends are each found in
    one pass, so that many beginnings without an end cost no more than the text is long."""
    ends = [m.span() for m in _compiled(rule.until).finditer(text)]
    out, k, free = [], 0, 0
    for m in _compiled(rule.pattern).finditer(text):
        if m.start() < free:
            continue
        while k < len(ends) and ends[k][0] < m.end():
            k += 1
        if k == len(ends):
            break
        out.append((m.start(), free := ends[k][1]))
    return out


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)  # the re module keeps compiled patterns


SPANS = "array<struct<kind:string,start:int,end:int>>"
#: The ledger: which rule version has seen which blob, and what it found there.
LEDGER = f"blob string, rule string, spans {SPANS}"


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", version_col: str | None = None) -> DataFrame:
    """(path, version, text, blob) of rows that hold a file's text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    version = F.col(version_col).cast("long") if version_col else F.lit(0).cast("long")
    return docs.select(F.col(path_col).alias("path"), version.alias("version"), text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def update(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: every (blob, rule version) of history that it doesn't hold yet.

    history: as versions() gives it. A blob is read from one row, the one of its smallest path
    and version: which that is, is worked out over the addresses alone, so a blob that a third
    of all paths share is never gathered; the texts are shuffled once, by their own row's key,
    and not sorted. Rows that repeat path, version and blob are scanned again and folded.
    """
    keys = [r.key for r in rules]
    own = F.struct("path", "version")
    one = history.groupBy("blob").agg(F.min(own).alias("at"))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        one = one.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))))
        one = one.where(F.size("todo") > 0)
    else:
        one = one.withColumn("todo", F.array(*map(F.lit, keys)))
    at = lambda path, version: F.xxhash64(path, version)
    one = one.select(F.col("blob").alias("b"), F.col("at.path").alias("p"), F.col("at.version").alias("v"), "todo", at(F.col("at.path"), F.col("at.version")).alias("k"))
    texts = history.select("path", "version", "text", "blob", at(F.col("path"), F.col("version")).alias("k2"))
    todo = texts.join(one.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & (F.col("b") == F.col("blob")) & F.col("p").eqNullSafe(F.col("path")) & F.col("v").eqNullSafe(F.col("version")))

    def start():
        by_key = {r.key: r for r in rules}

        def run(cols):
            out = []
            for text, todo in zip(cols[1], cols[2]):
                some = tuple(by_key[k] for k in keys if k in todo)
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in scan_text(text, some)])
            return [cols[0], cols[2], out]

        return run

    found = map_rows(todo.select("blob", "text", "todo"), start, f"blob string, todo array<string>, spans {SPANS}")
    of_rule = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.key))])
    rows = found.dropDuplicates(["blob"]).select("blob", F.explode("todo").alias("rule"), "spans")
    return rows.select("blob", "rule", F.filter("spans", lambda s: of_rule[s["kind"]] == F.col("rule")).alias("spans"))


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, spans) for every version, by the ledger's rows of the rules' versions.

    Only rows with findings are joined; a version without any has an empty list. Spans are
    ordered by start, then by the rules' order. The join is by blob and plain, so adaptive
    execution can split a blob that very many paths hold.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    key = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).groupBy("blob").agg(F.sort_array(key).alias("hits"))
    hits = hits.select(F.col("blob").alias("b"), F.transform("hits", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("hits"))
    rows = history.select("path", "version", "blob").join(hits, F.col("blob") == F.col("b"), "left")
    return rows.select("path", "version", "blob", F.coalesce("hits", F.array().cast(SPANS)).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """findings() of a table of documents with an empty ledger: (path, version, blob, spans)."""
    history = versions(docs)
    return findings(history, cut(update(history, None, rules)), rules)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base rules' counts and digest, and all spans as text."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = [r.kind for r in rules if r.base]
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    merged = reduce(lambda acc, s: acc[:-1] + [(acc[-1][0], acc[-1][1], max(acc[-1][2], s[2]))] if acc and s[1] < acc[-1][2] else [*acc, s], spans, [])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redact_column(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, with every finding in text replaced by its kind in brackets, and
    n_chars counted anew where the text changed. A null text stays null. Texts are shuffled once more, by
    blob; adaptive execution can split a blob that very many rows share."""
    history = versions(docs)
    ledger = cut(update(history, None, rules))
    hits = findings(history.select("path", "version", "blob").dropDuplicates(["blob"]), ledger, rules).where(F.size("spans") > 0)
    hits = cut(hits.select(F.col("blob").alias("__b"), F.col("spans").alias("__spans")))
    blob = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    met = docs.withColumn("__blob", blob).join(hits.hint("shuffle_hash"), F.col("__blob") == F.col("__b"), "left")

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else redact(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(text, spans)])

    out = met.withColumn("__new", cleaned(F.col("text"), F.col("__spans")))
    changed = {"text": F.col("__new"), "n_chars": F.when(F.col("__spans").isNotNull(), F.char_length("__new").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
