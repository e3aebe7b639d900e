"""License scans by ordered signature rules (DataFrame expressions only).

A text becomes its words: lower case, one space between. Rules are regular expressions
over that; each has a keyword that must be among the words before the expression is
tried, and a priority. A detection that lies within another one of higher priority, or
of the same priority and starting no later, is suppressed. Everything happens within a
row: nothing is shuffled, and texts without any license word are only counted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import bound, running_fold, text_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a text in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters that stand in no word.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

# Phrases that are always reported, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_VERSION = f"(?:{_GAP}v(?:ersion)?|v)?(?:{_GAP})?"
#: What a text must hold for any of :data:`RULES` or a base phrase to hold: of each
#: signature one word, or some in a row with any gap between them; of the names that need
#: no "license", the name and the first digit of the version.
_GATE = (
    "(?i)(?=[lcswprdagntu])(?:licen[cs]e|copyright|spdx"
    f"|gpl{_VERSION}[123]|apache(?:{_GAP}software)?{_VERSION}[12]"
    f"|rights{_GAP}reserved|without{_GAP}(?:any{_GAP}express|warranty)|public{_GAP}domain"
    f"|permission{_GAP}(?:is|to)|redistribution{_GAP}and|neither{_GAP}the{_GAP}name|advertising{_GAP}materials"
    f"|software{_GAP}developed{_GAP}by|terms{_GAP}as{_GAP}perl|to{_GAP}the{_GAP}extent{_GAP}possible|unencumbered{_GAP}software"
    f"|(?:released|distributed|published|available|provided){_GAP}(?:under|according|subject))"
)


@dataclass(frozen=True)
class Rule:
    """A signature: a label, the keyword that gates it, the expression, the priority."""

    label: str
    keyword: str
    pattern: str
    priority: int


# Identifier, keywords and the words of the name, as an expression. Each
# match must hold one of the keywords as a whole word.
_NAMED = (
    ("mit", "mit", "mit"), ("mit-0", "mit", "mit 0|mit no attribution"), ("x11", "x11", "x11"),
    ("expat", "expat", "expat"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"),
    ("apache-1.1", "apache|apache1", "(?:apache(?: software)?(?: license)?(?: version| v)? ?1|apache1) 1"),
    ("apache-2.0", "apache|apache2", "(?:apache(?: software)?(?: license)?(?: version| v)? ?2|apache2)(?: 0)?"),
    ("bsd-2-clause", "bsd|freebsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "bsd|0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("gfdl-1.3", "gnu", "gnu free documentation license(?: version| v)? ?1 3"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.1", "distribution", "common development and distribution license(?: version| v)? ?1 1"),
    ("cpl-1.0", "common", "common public license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.1", "european", "european union public licen[cs]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("artistic-1.0", "artistic", "artistic license(?: version| v)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? ?2(?: 0)?"),
    ("bsl-1.0", "boost", "boost software license(?: version| v)?(?: ?1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("ncsa", "ncsa", "ncsa"),
    ("postgresql", "postgresql", "postgresql"), ("python-2.0", "python", "python software foundation license(?: version| v)? ?2"),
    ("php-3.01", "php", "php license(?: version| v)? ?3 01"), ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"), ("ofl-1.1", "sil", "sil open font license(?: version| v)?(?: ?1 1)?"),
    ("odbl-1.0", "database", "open database license(?: version| v)?(?: ?1(?: 0)?)?"),
    ("cecill-2.1", "cecill|cecill2", "(?:cecill(?: version| v)? ?2|cecill2) 1"), ("osl-3.0", "open", "open software license(?: version| v)? ?3(?: 0)?"),
    ("afl-3.0", "academic", "academic free license(?: version| v)? ?3(?: 0)?"),
    ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("vim", "vim", "vim"), ("w3c", "w3c", "w3c(?: software)?"), ("sspl-1.0", "server", "server side public license(?: version| v)? ?1"),
    ("busl-1.1", "business", "business source license(?: version| v)? ?1 1"), ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
)
# The GNU family's abbreviations, names and versions.
_GNU = (
    ("gpl", "general public license", ("1.0", "2.0", "3.0")),
    ("lgpl", "(?:library|lesser) general public license", ("2.0", "2.1", "3.0")),
    ("agpl", "affero general public license", ("1.0", "3.0")),
)
# What says that a later version, or no other, will do as well.
_ONWARDS = {"": "", "-or-later": " or(?: at your option)?(?: any)? later(?: version)?", "-only": " only"}
# The parts and versions of the Creative Commons family.
_COMMONS_PARTS = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s",
    "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}
_COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Signatures from the wording of notices and licenses.
_OTHER = (
    Rule("all-rights-reserved", "reserved", "all rights reserved", 1),
    Rule("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 1),
    Rule("public-domain", "domain", "(?:dedicated to|released into|placed in) the public domain", 3),
    Rule("no-warranty", "warranty", "without warranty of any kind", 1),
    Rule("license-reference", "license", r"see (?:the )?license(?: file)?(?: for details)?", 1),
    Rule("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    Rule("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies", 3),
    Rule("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 4),
    Rule("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose", 4),
    Rule("bsd", "redistribution", "redistribution and use in source and binary forms", 4),
    Rule("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms(?: [^ ]+){1,60}? this software is provided by", 4),
    Rule("bsd-3-clause", "endorse", "neither the name of(?: [^ ]+){1,15}? (?:nor|or) the names of (?:its|his|their|any) contributors may be used to endorse", 4),
    Rule("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 4),
    Rule("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 4),
    Rule("apache-2.0", "apache", "apache license version 2 0 the license you may not use this file except in compliance with the license", 4),
    Rule("apache-2.0", "apache", "may obtain a copy of the license at https? www apache org licenses license 2 0", 4),
    Rule("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 4),
    Rule("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 4),
    Rule("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 4),
    Rule("epl-2.0", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 4),
    Rule("cddl-1.0", "distribution", "the contents of this file are subject to the terms of the common development and distribution license", 4),
    Rule("zlib", "express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 4),
    Rule("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 4),
    Rule("wtfpl", "license", "do what the fuck you want to public license", 4),
    Rule("cc0-1.0", "law", "to the extent possible under law(?: [^ ]+){1,20}? has waived all copyright", 4),
    Rule("perl", "perl", "under the same terms as perl(?: itself)?", 3),
    Rule("openssl", "openssl", "this product includes software developed by the openssl project", 4),
    Rule("python-2.0", "psf", "psf license agreement for python", 4),
    Rule("bsl-1.0", "boost", "distributed under the boost software license version 1 0", 4),
    Rule("gfdl", "gnu", "gnu free documentation license", 2),
    Rule("bsd", "bsd", "bsd(?: style| type)? licen[cs]e", 1),
    Rule("gpl", "gpl", "(?:gnu )?gpl licen[cs]e", 1),
    Rule("lgpl", "lgpl", "(?:gnu )?lgpl licen[cs]e", 1),
    Rule("agpl", "agpl", "(?:gnu )?agpl licen[cs]e", 1),
)
_GRANT = (
    "(?:licensed|(?:licensed|released|distributed|published|available|provided|redistributed)"
    " (?:under|according to|subject to))(?: the| an?)?(?: terms(?: and conditions)? of)?(?: the)? "
)
_HEADER = "licen[cs]e(?: type| name)?(?: is)?(?: the)? "


def _gnu_rules() -> list[Rule]:
    """The names, abbreviations and notices of the GNU family, by version and what follows it."""
    found = []
    for short, words, versions in _GNU:
        found.append(Rule(short, short, f"(?:{_HEADER}|{_GRANT})(?:gnu )?{short}", 2))
        for version in versions:
            major, minor = version.split(".")
            number = f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?"
            name = f"(?:gnu {words}|(?:gnu )?{short})(?: version| v|v)? ?{number}"
            notice = f"gnu {words} as published by the free software foundation(?: either)?(?: version| v)? ?{number}(?: of the license)?"
            # Words by which a name or notice can be told: each is tried under one of them.
            keywords = ("gnu", short, f"{short}v{major}", f"{short}{major}")
            for more, onwards in _ONWARDS.items():
                label = f"{short}-{version}{more}"
                tag = f"{short} {major} {minor}{more.replace('-', ' ')}"
                found += [
                    Rule(label, "spdx", f"spdx license identifier {tag}", 4),
                    Rule(label, "gnu", f"{notice}{onwards}", 4),
                ]
                for word in keywords:
                    found += [
                        Rule(label, word, f"{_GRANT}{name}{onwards}(?: licen[cs]e)?", 3),
                        Rule(label, word, f"(?:{_HEADER})?{name}{onwards}(?: licen[cs]e)?", 2),
                    ]
    return found


def rules() -> tuple[Rule, ...]:
    """All signatures in order of priority: wordings, the GNU family, and four forms of each other name.

    4: an SPDX tag or a whole grant; 3: a sentence that licenses under the name;
    2: the name before or behind the word "license"; 1: an address that names it, or a bare mention.
    """
    names = [(label, keyword, pattern, label.replace("-", " ").replace(".", " ")) for label, keyword, pattern in _NAMED]
    for part, words in _COMMONS_PARTS.items():
        for version in _COMMONS_VERSIONS:
            label = f"cc-{part.replace(' ', '-')}-{version.replace(' ', '.')}"
            pattern = f"(?:cc {part}|creative commons {words})(?: licen[cs]e)?(?: version| v)? ?{version}(?: international| unported)?"
            names.append((label, "cc|commons", pattern, f"cc {part} {version}"))
    found = [*_OTHER, *_gnu_rules()]
    found += [Rule(label, "bsd", f"(?:{_HEADER}|{_GRANT})(?:{words})", 2) for label, words in (("bsd", "bsd"), ("bsd-2-clause", "2 clause bsd"))]
    for label, keyword, pattern, tag in names:
        found += [
            Rule(label, "spdx", f"spdx license identifier {tag}", 4),
            Rule(label, "licenses", f"(?:opensource org|spdx org|creativecommons org) licenses {tag.removeprefix('cc ')}", 1),
        ]
        # A name that says what it is needs no such word behind it.
        named = "(?: licen[cs]e)?" if "license" in pattern else " licen[cs]e"
        for word in keyword.split("|"):
            found += [
                Rule(label, word, f"{_GRANT}(?:{pattern})(?: licen[cs]e)?", 3),
                Rule(label, word, f"{_HEADER}(?:{pattern})", 2),
                Rule(label, word, f"(?:{pattern}){named}", 2),
            ]
    return tuple(sorted(found, key=lambda r: -r.priority))


RULES = rules()
#: How sure a detection of each priority is.
CONFIDENCE = {4: 1.0, 3: 0.9, 2: 0.7, 1: 0.3}


def _gate(rules_: tuple[Rule, ...]) -> str:
    """An expression that a text must match for any of the rules or base phrases to hold."""
    if rules_ is RULES:
        return _GATE
    return "(?i)" + "|".join(sorted({"license"} | {r.keyword for r in rules_}))


def _count_words(text: Column) -> Column:
    """The number of words. Blanks for what stands in no word make this a plain split."""
    blank = F.translate(text, _BETWEEN, " " * len(_BETWEEN))
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def _detections(text: Column, rules_: tuple[Rule, ...]) -> Column:
    """``start, end, priority, label`` of every match of every rule, in words.

    ``text`` is a column of words with one blank around each; being a column, it isn't
    put together anew for each rule.
    """
    by_keyword: dict[str, list[dict]] = {}
    for r in rules_:
        entry = {"pattern": f"(?<= )(?:{r.pattern})(?= )", "priority": r.priority, "label": r.label}
        by_keyword.setdefault(r.keyword, []).append(entry)
    # One constant, which is folded once; an expression for each rule would take long to analyse.
    table = F.from_json(
        F.lit(json.dumps([{"keyword": f" {word} ", "rules": some} for word, some in by_keyword.items()])),
        "array<struct<keyword:string,rules:array<struct<pattern:string,priority:int,label:string>>>>",
    )

    def places(rule: Column) -> Column:
        # What stands between the matches, and the matches, have as many spaces before
        # a place as there are words before it.
        between = F.split(text, rule["pattern"], -1)
        matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        widths = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(_spaces(b).alias("b"), _spaces(m).alias("m")))
        def placed(some: Column) -> Column:
            ends = running_fold(F.transform(some, lambda w: w["b"] + w["m"]), F.lit(0), lambda a, b: a + b)
            return F.zip_with(
                some, ends,
                lambda w, end: F.struct((end - w["m"] - 1).alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label")),
            )

        return bound(widths, placed)

    some = F.filter(table, lambda k: F.contains(text, k["keyword"]))
    return F.flatten(F.transform(F.flatten(F.transform(some, lambda k: k["rules"])), places))


def _unsuppressed(found: Column) -> Column:
    """The detections that lie within no stronger one.

    In order of start, wider and stronger first, whatever may hold a detection comes
    before it, so the largest end so far of each priority decides.
    """
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["end"]).alias("minus_end"), (-d["priority"]).alias("minus_priority"), d["label"].alias("label")
            ),
        )
    )
    levels = sorted(CONFIDENCE)

    def kept(some: Column) -> Column:
        detections = F.transform(
            some,
            lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"].alias("label")),
        )

        def chosen(all_of: Column) -> Column:
            # The largest end so far of detections of a priority or a higher one.
            def ends_of(p: int) -> Column:
                return F.transform(all_of, lambda d: F.when(d["priority"] >= p, d["end"]).otherwise(F.lit(0)))

            upto = F.array(*(running_fold(ends_of(p), F.lit(0), F.greatest) for p in levels))
            places = {p: i for i, p in enumerate(levels)}

            def apart(ends: Column) -> Column:
                def free(d: Column, i: Column) -> Column:
                    level = reduce(lambda a, p: F.when(d["priority"] == p, places[p]).otherwise(a), levels, F.lit(0))
                    return (i == 0) | (F.get(F.get(ends, level), i - 1) < d["end"])

                return F.filter(all_of, free)

            return bound(upto, apart)

        return bound(detections, chosen)

    return bound(ordered, kept)


def _base_places(words: Column) -> Column:
    """``at, label`` of every place where the words of a base phrase stand in a row."""

    def label_at(word: Column, i: Column) -> Column:
        whens = None
        for phrase, label in BASE_PHRASES.items():
            first, *rest = phrase.split()
            here = word == first
            for k, more in enumerate(rest, 1):
                here = here & F.coalesce(F.get(words, i + k) == more, F.lit(False))
            whens = F.when(here, label) if whens is None else whens.when(here, label)
        return F.struct(i.alias("at"), whens.alias("label"))

    return F.filter(F.transform(words, label_at), lambda p: p["label"].isNotNull())


def scan_licenses(docs: DataFrame, rules_: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, base, detections`` for each row.

    ``base`` has ``at, label`` of each place of a base phrase; ``detections`` has
    ``start, end, priority, label`` of what no stronger detection holds; all in words
    from 0. Null and empty texts have no words. Repeated rows come out as often as they
    are there; columns besides the two are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("_text"))
    gate = F.col("_text").rlike(_gate(rules_))
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.translate("_text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = rows.select(
        "doc_id",
        _count_words(F.col("_text")).alias("n_words"),
        F.when(gate, words).otherwise(none).alias("_words"),
    ).withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.size("_words") > 0, _base_places(F.col("_words"))).alias("base"),
        F.when(F.size("_words") > 0, _unsuppressed(_detections(F.col("_line"), rules_))).alias("detections"),
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("base", F.array().cast("array<struct<at:int,label:string>>")).alias("base"),
        F.coalesce("detections", F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")).alias("detections"),
    )


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, places, labels and a score from 0 to 1 for each row of a scan.

    The score is the confidence of the surest detection; a base phrase by itself has
    that of a name followed by "license".
    """
    at, base = F.col("base.at"), F.array_sort(F.array_distinct("base.label"))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("detections.label"))))
    strongest = F.greatest(
        F.coalesce(F.array_max("detections.priority"), F.lit(0)), F.when(F.size("base") > 0, 2).otherwise(0)
    )
    score = F.lit(0.0)
    for priority, sure in CONFIDENCE.items():
        score = F.when(strongest == priority, sure).otherwise(score)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
