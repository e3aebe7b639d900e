"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every
matching text satisfies. The trigrams that the rules ask for are indexed for a block of
texts at a time, as postings of row numbers; a rule's query is answered by intersecting
and uniting postings, and only the rows that remain are matched. A rule without any
mandatory trigram scans all rows. Blocks are Arrow batches, so nothing is shuffled and
memory is bounded by a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as op
from re import _parser

from vintara.llm.common import text_of

#: A query: None holds for every text; a string is a trigram; ("and" | "or", parts).
Query = None | str | tuple

#: Literal strings followed at once before a query is made of them.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what a match must satisfy to count."""

    kind: str
    pattern: str
    accepts: Callable[[re.Match], bool] = lambda match: True


def _at_least(n: int, group: int = 0) -> Callable[[re.Match], bool]:
    return lambda match: len(match[group]) >= n


# The kinds every scan reports, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _at_least(6, 2)),
    Rule("access", r"AKIA[A-Z0-9]+", _at_least(20)),
    # A run of hexadecimal digits is a maximal one, so its least length can stand in the rule.
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of well-known credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("gitlab_runner", r"glrt-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_app", r"xapp-[0-9]-[A-Z0-9]+-[0-9]+-[a-z0-9]+"),
    Rule("slack_hook", r"https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{20,}"),
    Rule("discord_hook", r"https://(?:www\.)?discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]{30,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("google_client", r"[0-9]{6,}-[0-9a-z]{32}\.apps\.googleusercontent\.com"),
    Rule("google_secret", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    Rule("google_token", r"ya29\.[0-9A-Za-z_-]{20,}"),
    Rule("aws_temporary", r"(?:ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Z0-9])"),
    Rule("aws_secret", r"(?i:aws_?secret_?access_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9/+=]{40}"),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("azure_signature", r"[?&]sig=[A-Za-z0-9%]{43,}%3[dD]"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("stripe_hook", r"whsec_[A-Za-z0-9+/]{32,}"),
    Rule("square", r"sq0(?:atp|csp)-[0-9A-Za-z_-]{22,}"),
    Rule("square_live", r"EAAA[A-Za-z0-9_-]{60}"),
    Rule("paypal_live", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("twilio", r"(?:AC|SK)[0-9a-f]{32}(?![0-9a-f])"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("mailgun", r"key-[0-9a-f]{32}(?![0-9a-f])"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgE[A-Za-z0-9_-]{50,}"),
    Rule("rubygems", r"rubygems_[0-9a-f]{48}"),
    Rule("nuget", r"oy2[a-z0-9]{43}"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{27}"),
    Rule("heroku", r"HRKU-[A-Za-z0-9_-]{36,}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
    Rule("notion", r"ntn_[A-Za-z0-9]{40,}"),
    Rule("figma", r"figd_[A-Za-z0-9_-]{40}"),
    Rule("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("new_relic", r"NRAK-[A-Z0-9]{27}"),
    Rule("grafana", r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("hugging_face", r"hf_[A-Za-z]{34}"),
    Rule("vault", r"hv[sb]\.[A-Za-z0-9_-]{24,}"),
    Rule("age_key", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"),
    Rule("putty_key", r"PuTTY-User-Key-File-[23]"),
    # Classes that don't give back what they took keep long runs linear.
    Rule("url_login", r"[a-z][a-z0-9+]{1,9}://[^\s:/@]++:[^\s:/@]++@"),
    Rule("bearer", r"(?i:authorization)\x20*[:=]\x20*[\"']?(?i:bearer|basic)\x20+[A-Za-z0-9+/_.=~-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


def fold(text: str) -> str:
    """A-Z to lower case, as the index has them."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def _join(kind: str, parts: list[Query]) -> Query:
    """The parts joined, with what says nothing left out."""
    if kind == "or" and None in parts:
        return None
    some = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not some else some[0] if len(some) == 1 else (kind, *some)


def _of_strings(strings: set[str]) -> Query:
    """What a text satisfies that holds one of the strings."""
    if any(len(s) < 3 for s in strings):
        return None
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list, most: int = 6) -> set[str] | None:
    """The folded characters of a class if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(fold(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < most:
            found |= {fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= most else None


def _walk(nodes, strings: set[str], queries: list[Query]) -> set[str]:
    """Follow a sequence of parsed nodes.

    ``strings`` are what the text may hold just before the next node; the result is the
    same after the last node. What is certain before goes to ``queries``.
    """

    def add(more: set[str]) -> set[str]:
        if len(strings) * len(more) > MOST_STRINGS:
            queries.append(_of_strings(strings))
            return more if len(more) <= MOST_STRINGS else {""}
        return {a + b for a in strings for b in more}

    def cut() -> set[str]:
        queries.append(_of_strings(strings))
        return {""}

    for kind, value in nodes:
        if kind is op.LITERAL:
            # Characters of more than one byte aren't followed; the index is of ASCII.
            strings = add({fold(chr(value))}) if value < 128 else cut()
        elif kind is op.IN:
            few = _members(value)
            strings = add(few) if few and all(c < "\x80" for c in few) else cut()
        elif kind is op.SUBPATTERN:
            strings = _walk(value[3], strings, queries)
        elif kind is op.BRANCH:
            ends: set[str] = set()
            inner: list[Query] = []
            for branch in value[1]:
                own: list[Query] = []
                ends |= (end := _walk(branch, {""}, own))
                inner.append(_join("and", own + [_of_strings(end)]))
                if any(q is not None for q in own):
                    ends.add("")
            exact = "" not in ends
            if exact and len(ends) <= MOST_STRINGS and _only_literals(value[1]):
                strings = add(ends)
            else:
                strings = cut()
                queries.append(_join("or", inner))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, body = value
            if low == 0 and high == 1 and _only_literals([body]):
                strings = add({""} | _walk(body, {""}, []))
            elif low == 0:
                strings = cut()
            else:
                strings = _walk(body, strings, queries)
                strings = strings if (low, high) == (1, 1) else cut()
        elif kind is op.AT:
            pass
        else:
            strings = cut()
    return strings


def _only_literals(branches) -> bool:
    """Whether the strings of the branches are all there is to them."""

    def plain(kind, value) -> bool:
        if kind is op.LITERAL:
            return value < 128
        if kind is op.IN:
            few = _members(value)
            return bool(few) and all(c < "\x80" for c in few)
        if kind is op.SUBPATTERN:
            return all(plain(*n) for n in value[3])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            return value[0] == 0 and value[1] == 1 and all(plain(*n) for n in value[2])
        return False

    return all(plain(*n) for branch in branches for n in branch)


def trigram_query(pattern: str) -> Query:
    """A query that every text with a match of ``pattern`` satisfies; None if there is none."""
    queries: list[Query] = []
    end = _walk(_parser.parse(pattern), {""}, queries)
    return _join("and", queries + [_of_strings(end)])


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


class TrigramIndex:
    """Postings of the wanted trigrams over a block of texts."""

    #: Bytes looked at in one step, to bound the memory taken.
    STEP = 4 << 20

    def __init__(self, wanted: list[str]):
        self._codes = np.array(sorted({int.from_bytes(t.encode(), "big") for t in wanted}), np.uint32)
        self._number = np.full(1 << 24, -1, np.int16)
        self._number[self._codes] = np.arange(len(self._codes), dtype=np.int16)
        self._fold = np.arange(256, dtype=np.uint8)
        self._fold[65:91] += 32
        self.postings: list[np.ndarray] = []

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Index rows whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""
        found = []
        first, end = int(offsets[0]), int(offsets[-1])
        n_rows = len(offsets) - 1
        for low in range(first, end, self.STEP):
            part = self._fold[data[low : min(end, low + self.STEP + 2)]].astype(np.uint32)
            if len(part) < 3:
                continue
            number = self._number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(number >= 0)
            row = np.searchsorted(offsets, at + low, "right") - 1
            inside = at + low + 2 < offsets[row + 1]
            found.append(np.unique(number[at[inside]].astype(np.int64) * n_rows + row[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        cuts = np.searchsorted(pairs, np.arange(len(self._codes) + 1) * n_rows)
        self.postings = [pairs[a:b] % n_rows if n_rows else pairs for a, b in zip(cuts, cuts[1:])]

    def rows(self, query: str | tuple) -> np.ndarray:
        """The rows that satisfy a query, in order."""
        if isinstance(query, str):
            code = int.from_bytes(query.encode(), "big")
            return self.postings[int(np.searchsorted(self._codes, code))]
        parts = [self.rows(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        left = parts[0]
        for more in parts[1:]:
            left = np.intersect1d(left, more, assume_unique=True)
        return left


@lru_cache(maxsize=4)
def _prepared(rules: tuple[tuple[str, str], ...]) -> tuple[list[re.Pattern], list[Query], TrigramIndex]:
    queries = [trigram_query(pattern) for _, pattern in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    return [re.compile(pattern, re.ASCII) for _, pattern in rules], queries, TrigramIndex(wanted)


def _scan(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled, queries, index = _prepared(tuple((r.kind, r.pattern) for r in rules))
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        index.build(np.frombuffer(data or b"", np.uint8), offsets)
        due: list[list[int]] = [[] for _ in range(len(texts))]
        for r, query in enumerate(queries):
            for row in range(len(texts)) if query is None else index.rows(query).tolist():
                due[row].append(r)
        spans = []
        for row, which in enumerate(due):
            found = []
            if which:
                text = texts[row].as_py()
                for r in which:
                    found += [(m.start(), r, m.end()) for m in compiled[r].finditer(text) if rules[r].accepts(m)]
            spans.append([{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"]
        )


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: for each row the spans of its secrets, by start and then rule.

    A span is ``kind, start, end`` in code points, the end exclusive. Matches of a rule
    are leftmost and don't overlap; those the rule doesn't accept are dropped. Spans of
    different rules may overlap. Null and empty texts have no spans; repeated rows have
    their spans each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(
        lambda batches: _scan(rules, batches), "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def span_text(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    return found.select(
        "doc_id",
        *(
            F.size(F.filter(F.col("spans.kind"), lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}")
            for kind in base
        ),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
