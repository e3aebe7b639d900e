"""Personal data: detection, and information-theoretic sanitisation (no Python code in tasks).

Entities are found by expressions: e-mail and IP addresses, card and phone numbers. Words
near them may reveal them too. How strongly a term ``t`` reveals an entity ``e`` is estimated
from the whole corpus by pointwise mutual information,

    PMI(t, e) = log p(t, e) / (p(t) p(e)),

where ``p(t)`` is the share of the corpus' terms outside entities that are ``t``, ``p(e)`` the share of terms
that stand near ``e``, and ``p(t, e)`` the share that are ``t`` and do. A term that always stands near
``e`` has PMI equal to its information, ``-log p(e)``. The estimate is made twice: for each
entity that recurs, such as one mailbox and the name beside it, and for each kind of entity,
as most entities are too rare to be estimated by themselves. Terms whose PMI is at least
``ENTITY_DISCLOSURE``, or ``DISCLOSURE``, of that information are sanitised wherever they stand: those
that :data:`GENERAL` knows are generalised to what it says, others are removed, and a label stands in
their place as it does for entities.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import bound, running_fold, saved, slices_of, text_of

#: Share of a kind's, and of a single entity's, information that a term may not reveal.
DISCLOSURE = 0.9
ENTITY_DISCLOSURE = 0.97
#: Occurrences near entities, and different texts with one entity, below which the corpus gives no estimate.
SUPPORT = 5
#: Characters on each side of an entity that are near it.
NEAR = 40
#: Disclosing terms up to which each word is looked up among them in place; beyond, they meet the words in a join.
ROW_TERMS = 5_000
#: Rows with sanitised terms up to which they are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000

# Without surrogates, which are halves of other characters.
_TERM = "[a-z\u0080-\ud7ff\ue000-\uffff]"
_NO_TERM = f"[^{_TERM[1:-1]}]++"


@dataclass(frozen=True)
class Kind:
    """A kind of entity: what a text must hold, the expression, what a match must satisfy."""

    name: str
    gate: str
    pattern: str
    accepts: object


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(number) > 3, False).otherwise(F.concat(F.lit("0"), F.substring(number, 1, 3)).cast("int") <= 255)

    return F.forall(F.split(match, r"\."), small)


# The kinds every scan reports, in the order in which they are listed. The
# quantifiers don't give back what they took, and look-behinds let a match start only at
# the beginning of a run (or where the match before ended): the matches are the same, but
# long runs take linear time and no stack.
BASE_KINDS = (
    Kind(
        "email",
        "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
    ),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts),
    Kind(
        "card",
        "[0-9](?:[ -]?[0-9]){13}",
        # A match is a whole run of digits with single separators; only runs of 14 to 19 can count.
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
        lambda m: F.call_function("luhn_check", _digits(m)),
    ),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15)),
)
TERM_KIND = "term"
# What terms are generalised to, and the terms.
_GENERAL = {
    "title": "mr mrs ms miss dr prof sir madam herr frau monsieur madame mademoiselle señor señora don doña",
    "relation": "mother father wife husband son daughter brother sister mutter vater tochter bruder schwester mère père frère sœur madre padre hijo hija hermano hermana",
    "occupation": "doctor nurse teacher lawyer engineer manager director professor student ingenieur lehrer arzt médecin professeur abogado maestro",
    "organisation": "inc ltd llc corp company bank university hospital school gmbh verein firma société université hôpital empresa universidad banco",
    "place": "street road avenue lane square city town village country strasse straße weg platz stadt rue ville pays calle avenida ciudad london paris berlin madrid rome vienna",
    "date": "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday birthday januar februar märz juli oktober dezember janvier février juillet août décembre enero febrero julio agosto diciembre",
    "number": "one two three four five six seven eight nine ten hundred thousand eins zwei drei hundert tausend deux trois cent mille dos tres cien mil",
}
GENERAL = {word: name for name, words in _GENERAL.items() for word in words.split()}
KIND_NAMES = (*(k.name for k in BASE_KINDS), TERM_KIND, *_GENERAL)

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str | Column) -> Column:
    """``start, end, match`` of all matches, in code points from 0.

    What stands between the matches, and the matches, have the text's length together.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, F.lit(pattern), -1), 1, F.size(found))
    sizes = F.zip_with(between, found, lambda b, m: F.length(b) + F.length(m))
    ends = running_fold(sizes, F.lit(0), lambda a, b: a + b)
    return F.zip_with(
        found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))
    )


def entity_spans(text: Column) -> Column:
    """The spans of all base kinds: ``start, kind, end``, with ``kind`` a place in the list."""
    parts = []
    for number, kind in enumerate(BASE_KINDS):
        held = text.contains(kind.gate) if kind.gate == "@" else text.rlike(kind.gate)
        good = F.filter(matches(text, kind.pattern), lambda m: kind.accepts(m["match"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))
        parts.append(F.when(held, spans).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*parts))


def near_terms(text: Column, low: Column, spans: Column) -> Column:
    """``kind, start, entity, term, first`` of the terms near each span; cut words aren't terms.

    ``low`` is the lowered text, ``entity`` a hash of the span's own characters. A term near
    two entities is there for both; for each kind one of them is marked ``first``.
    """

    def side(begin: Column, end: Column, s: Column, window: Column, entity: Column, ragged_left: Column, ragged_right: Column) -> Column:
        # The text before this term in the window says where it stands; a run of letters
        # that the window's border may have cut is no term.
        found = F.filter(
            matches(window, f"{_TERM}++"),
            lambda m: ~(ragged_left & (m["start"] == 0)) & ~(ragged_right & (m["end"] == end - begin)),
        )
        return F.transform(
            found,
            lambda m: F.struct(
                s["kind"].alias("kind"), (begin + m["start"]).alias("start"), entity.alias("entity"), m["match"].alias("term")
            ),
        )

    def around(s: Column, size: Column, of_text, of_low) -> Column:
        left, right = F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["end"] + NEAR, size)
        entity = F.xxhash64(F.lower(of_text(s["start"], s["end"])))
        both = lambda e: F.concat(
            side(left, s["start"], s, of_low(left, s["start"]), e, left > 0, F.lit(False)),
            side(s["end"], right, s, of_low(s["end"], right), e, F.lit(False), right < size),
        )
        return bound(entity, both)

    def all_of(size: Column) -> Column:
        return slices_of(text, lambda of_text: slices_of(low, lambda of_low: F.transform(spans, lambda s: around(s, size, of_text, of_low))))

    found = F.array_sort(F.flatten(bound(F.length(low), all_of)))
    # Equal ones follow each other.
    return bound(found, lambda some: F.filter(some, lambda x, i: (i == 0) | (x != F.get(some, i - 1))))


def _marked_first(near: Column) -> Column:
    """Sorted terms with ``first``: whether the one before has another kind or place."""

    def mark(x: Column, i: Column) -> Column:
        before = F.get(near, i - 1)
        first = (i == 0) | (before["kind"] != x["kind"]) | (before["start"] != x["start"])
        return F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["term"].alias("term"), first.alias("first"))

    return F.transform(near, mark)


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, n``: occurrences of every term in the corpus, outside entities."""
    words = F.split("_low", _NO_TERM)
    return rows.select(F.explode(words).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosing_terms(
    rows: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, entity_disclosure: float = ENTITY_DISCLOSURE
) -> DataFrame:
    """``term``: those that reveal too much about a kind of entity or about a single entity.

    ``near`` has a row ``text_hash, kind, entity, term, first`` for each occurrence of a term
    near an entity of ``rows``.
    """
    counts = saved(term_counts(rows))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # log(joint / n) - log p(e) >= disclosure * -log p(e)
    joint = saved(near.where("first").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("joint")))
    shares = {r["kind"]: r["near"] / total for r in joint.groupBy("kind").agg(F.sum("joint").alias("near")).collect()}
    least = F.lit(2.0)
    for kind, share in shares.items():
        least = F.when(F.col("kind") == kind, min(1.0, share) ** (1 - disclosure)).otherwise(least)
    of_kinds = joint.where(F.col("joint") >= support).select("term", "joint", least.alias("least"))
    # Copies of a text say nothing new about an entity: support is counted in different texts.
    pairs = near.groupBy("kind", "entity", "term", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("kind", "entity", "term").agg(F.sum("n").alias("joint"), F.count(F.lit(1)).alias("texts"))
    sizes = near.groupBy("kind", "entity").agg((F.count(F.lit(1)) / F.lit(max(1, total))).alias("share"))
    least = F.pow(F.least(F.col("share"), F.lit(1.0)), F.lit(1 - entity_disclosure))
    of_entities = pairs.where(F.col("texts") >= support).join(sizes, ["kind", "entity"]).select("term", "joint", least.alias("least"))
    some = of_kinds.unionByName(of_entities).join(counts, "term")
    return some.where(F.col("joint") / F.col("n") >= F.col("least")).select("term").distinct()


def _apart(spans: Column) -> Column:
    """The spans in order, overlapping ones as one of the first's kind."""

    def merged(some: Column) -> Column:
        ends = running_fold(F.transform(some, lambda s: s["end"]), F.lit(0), F.greatest)

        def groups(upto: Column) -> Column:
            # A span that begins at or after all ends before it begins a group.
            places = F.transform(some, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i")))
            heads = F.filter(places, lambda s, i: (i == 0) | (s["start"] >= F.get(upto, i - 1)))

            def whole(some_heads: Column) -> Column:
                last = lambda k: F.coalesce(F.get(some_heads, k + 1)["i"], F.size(upto)) - 1
                return F.transform(
                    some_heads, lambda h, k: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), F.get(upto, last(k)).alias("end"))
                )

            return bound(heads, whole)

        return bound(ends, groups)

    return bound(F.array_sort(spans), merged)


def _rewrite(text: Column, apart: Column, label) -> Column:
    """The text with what ``label`` says in place of each span."""

    def rewritten(cut) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.element_at(apart, F.greatest(i, F.lit(1)))["end"])
            return F.concat(cut(before, s["start"]), label(s))

        tail = F.element_at(apart, -1)["end"]
        return F.concat(F.array_join(F.transform(apart, piece), ""), F.substring(text, tail + 1, F.length(text) - tail))

    return F.when(F.size(apart) == 0, text).otherwise(slices_of(text, rewritten))


def _lowered(text: Column, apart: Column) -> Column:
    """The text in lower case, blanks for its entities; each character keeps its place."""
    blank = _rewrite(text, apart, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    # The one letter that lowering makes two of.
    return F.lower(F.translate(blank, "\u0130", "i"))


def _rows(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """``doc_id, text_hash, _text, spans, _low`` of each row, with ``more``."""
    whole = text_of(docs, text)
    rows = docs.select(
        *more,
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(whole).alias("text_hash"),
        whole.alias("_text"),
        entity_spans(whole).alias("spans"),
    ).withColumn("_apart", _apart(F.col("spans")))
    return rows.withColumn("_low", _lowered(F.col("_text"), F.col("_apart"))).drop("_apart")


def _revealing(rows: DataFrame, disclosure: float, support: int) -> DataFrame:
    """``term``: what discloses an entity in ``rows``, which :func:`_rows` made."""
    near = near_terms(F.col("_text"), F.col("_low"), F.col("spans"))
    held = rows.where(F.size("spans") > 0).select("text_hash", near.alias("_near"))
    near = saved(held.select("text_hash", F.inline(_marked_first(F.col("_near")))))
    return saved(disclosing_terms(rows, near, disclosure, support))


def _with_terms(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """``rows`` with ``terms``: the spans of every occurrence of a revealing term in the text.

    Their kind is what :data:`GENERAL` generalises the term to, or else a removed term's.
    """
    none = F.array().cast(_SPANS)
    some = revealing.count()
    if some == 0:
        return rows.withColumn("terms", none)
    words = F.split("_low", _NO_TERM)
    if some <= ROW_TERMS:
        # Looked up in a set that goes with the plan.
        listed = [r["term"] for r in revealing.collect()]
        held = rows.withColumn("_held", F.array_distinct(F.filter(words, lambda w: w.isin(listed))))
    else:
        each = rows.select("doc_id", "text_hash", F.explode(F.array_distinct(words)).alias("term")).join(revealing, "term")
        each = saved(
            each.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("term").alias("_held"))
        )
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        held = rows.join(F.broadcast(each) if each.count() <= BROADCAST_ROWS else each, same, "left")
    # Terms are letters alone and need no quoting.
    pattern = F.concat(F.lit(f"(?<!{_TERM})(?:"), F.array_join("_held", "|"), F.lit(f")(?!{_TERM})"))
    kinds = F.from_json(F.lit(json.dumps({word: KIND_NAMES.index(name) for word, name in GENERAL.items()})), "map<string,int>")
    kind = lambda m: F.coalesce(F.try_element_at(kinds, m["match"]), F.lit(KIND_NAMES.index(TERM_KIND)))
    spans = F.transform(
        matches(F.col("_low"), pattern), lambda m: F.struct(m["start"].alias("start"), kind(m).alias("kind"), m["end"].alias("end"))
    )
    return held.select(*rows.columns, F.when(F.size("_held") > 0, spans).otherwise(none).alias("terms"))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans, terms`` for each row: the base spans and those of disclosing terms.

    Null and empty texts have none; null ids are ids like others; repeated rows come out as
    often as they are there, each with its terms; other columns are ignored; an empty table gives no rows.
    """
    rows = _rows(docs, doc_id, text)
    return _with_terms(rows, _revealing(rows, disclosure, support)).select("doc_id", "spans", "terms")


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with entities and disclosing terms replaced by labels such as ``[EMAIL]``.

    A term is generalised to what :data:`GENERAL` calls it, such as ``[PLACE]``, or else removed,
    which leaves ``[TERM]``. Rows and columns stay; a column ``n_chars`` becomes the new length.
    A null text stays null; an empty table gives no rows.
    """
    rows = _rows(docs, doc_id, text, F.struct(*docs.columns).alias("_row"))
    joined = _with_terms(rows, _revealing(rows, disclosure, support))
    labels = F.array(*(F.lit(f"[{name.upper()}]") for name in KIND_NAMES))
    new = joined.withColumn("_apart", _apart(F.concat("spans", "terms")))
    new = new.withColumn("_text", _rewrite(F.col("_text"), F.col("_apart"), lambda s: F.get(labels, s["kind"])))
    value = F.when(F.col(f"_row.{text}").isNull(), F.lit(None)).otherwise(F.col("_text"))
    columns = []
    for name in docs.columns:
        kept = F.col("_row").getField(name)
        if name == text:
            kept = value
        elif name == n_chars:
            kept = F.coalesce(F.length(value).cast(docs.schema[name].dataType), kept)
        columns.append(kept.alias(name))
    return new.select(*columns)


def _span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KIND_NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE_KINDS)),
        F.sha2(_span_text(F.col("spans")), 256).alias("base_sha256"),
        _span_text(F.array_sort(F.concat("spans", "terms"))).alias("spans"),
    )
