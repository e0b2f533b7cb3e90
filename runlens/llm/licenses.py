"""License scans by ordered signature rules over the words of a text.

A rule is a regular expression over lower-cased words joined by single spaces. Rules are gated by keywords:
a rule runs only on texts that have one of its words. Detections are taken in order of priority, then length;
one that lies within an accepted detection is suppressed, so "licensed under the apache license version 2 0"
is one finding and not also "apache license".
"""

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Everything in ASCII but digits and small letters separates words.
_SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

BASE = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}

_V = r"(?: (?:version|v|versions))?"
# label: keyword, name as a pattern, version as a pattern, words of the identifier
FAMILIES = {
    "apache-1.1": ("apache", r"apache(?: software)?(?: license)?", r"v?1 1", "apache 1 1"),
    "apache-2.0": ("apache", r"apache(?: software)?(?: license)?", r"v?2(?: 0)?", "apache 2 0"),
    "gpl-1.0": ("gpl gnu", r"(?:gnu )?(?:gpl|general public licen[cs]e)", r"v?1(?: 0)?", "gpl 1 0"),
    "gpl-2.0": ("gpl gnu", r"(?:gnu )?(?:gpl|general public licen[cs]e)", r"v?2(?: 0)?", "gpl 2 0"),
    "gpl-3.0": ("gpl gnu", r"(?:gnu )?(?:gpl|general public licen[cs]e)", r"v?3(?: 0)?", "gpl 3 0"),
    "lgpl-2.0": ("lgpl lesser library", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", r"v?2(?: 0)?", "lgpl 2 0"),
    "lgpl-2.1": ("lgpl lesser library", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", r"v?2 1", "lgpl 2 1"),
    "lgpl-3.0": ("lgpl lesser library", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", r"v?3(?: 0)?", "lgpl 3 0"),
    "agpl-3.0": ("agpl affero", r"(?:gnu )?(?:agpl|affero general public licen[cs]e)", r"v?3(?: 0)?", "agpl 3 0"),
    "gfdl-1.2": ("gfdl fdl documentation", r"(?:gnu )?(?:g?fdl|free documentation licen[cs]e)", r"v?1 2", "gfdl 1 2"),
    "gfdl-1.3": ("gfdl fdl documentation", r"(?:gnu )?(?:g?fdl|free documentation licen[cs]e)", r"v?1 3", "gfdl 1 3"),
    "mpl-1.1": ("mpl mozilla", r"(?:mpl|mozilla(?: public)? licen[cs]e)", r"v?1 1", "mpl 1 1"),
    "mpl-2.0": ("mpl mozilla", r"(?:mpl|mozilla(?: public)? licen[cs]e)", r"v?2(?: 0)?", "mpl 2 0"),
    "epl-1.0": ("epl eclipse", r"(?:epl|eclipse public licen[cs]e)", r"v?1(?: 0)?", "epl 1 0"),
    "epl-2.0": ("epl eclipse", r"(?:epl|eclipse public licen[cs]e)", r"v?2(?: 0)?", "epl 2 0"),
    "eupl-1.2": ("eupl", r"(?:eupl|european union public licen[cs]e)", r"v?1 2", "eupl 1 2"),
    "cddl-1.0": ("cddl distribution", r"(?:cddl|common development and distribution licen[cs]e)", r"v?1(?: 0)?", "cddl 1 0"),
    "afl-3.0": ("afl academic", r"(?:afl|academic free licen[cs]e)", r"v?3(?: 0)?", "afl 3 0"),
    "artistic-2.0": ("artistic", r"(?:perl )?artistic licen[cs]e", r"v?2(?: 0)?", "artistic 2 0"),
    "osl-3.0": ("osl open", r"(?:osl|open software licen[cs]e)", r"v?3(?: 0)?", "osl 3 0"),
    "bsl-1.0": ("boost bsl", r"boost(?: software)? licen[cs]e", r"v?1(?: 0)?", "bsl 1 0"),
    "bsd-2-clause": ("bsd freebsd simplified", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "", "bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "", "bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e", "", "bsd 4 clause"),
    "mit": ("mit expat x11", r"(?:mit|expat|x11) licen[cs]e", "", "mit"),
    "isc": ("isc", r"isc licen[cs]e", "", "isc"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e", "", "zlib"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", "", "unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", "", "wtfpl"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e", "", "ms pl"),
    "odbl-1.0": ("odbl database", r"(?:odbl|open database licen[cs]e)", r"v?1(?: 0)?", "odbl 1 0"),
    "ofl-1.1": ("ofl sil font", r"(?:sil )?(?:ofl|open font licen[cs]e)", r"v?1 1", "ofl 1 1"),
    "psf-2.0": ("psf python", r"(?:psf|python software foundation|python) licen[cs]e", r"v?2(?: 0)?", "psf 2 0"),
    "cc0-1.0": ("cc0 creative", r"(?:cc0|creative commons (?:cc0|zero))", r"v?1(?: 0)?", "cc0 1 0"),
}
for _terms, _long in {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv[a-z]*",
                      "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
                      "by nc nd": "attribution non ?commercial no ?deriv[a-z]*"}.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _words = _version.replace(".", " ")
        FAMILIES[f"cc-{_terms.replace(' ', '-')}-{_version}"] = (
            "cc creative", rf"(?:cc {_terms}|creative commons {_long})(?: licen[cs]e)?", _words, f"cc {_terms} {_words}")

# Sentences that only one license, or its notice, has: label, keyword, pattern.
SENTENCES = [
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? (?:www )?apache org licenses license 2 0"),
    ("gpl", "gnu", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu", r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "gnu", r"gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "gnu", r"modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "affero", r"modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "boost", r"permission is hereby granted .{1,120} covered by this license the software"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
]
# Addresses: label by keyword and pattern.
ADDRESSES = [
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl(?: 3 0)?"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl(?: 3 0)?"),
    ("agpl-3.0", "gnu", r"gnu org licenses agpl(?: 3 0)?"),
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
]


class Rule(NamedTuple):
    priority: int  # smaller wins
    weight: float
    label: str
    keywords: tuple[bytes, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules: tags first, then sentences and addresses, grants, titles, names with and without version."""
    found = []

    def add(priority, weight, label, keywords, pattern):
        found.append(Rule(priority, weight, label, tuple(keywords.encode().split()), pattern))

    given = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|dual licen[cs]ed) (?:under|by|as|with)(?: the)?(?: terms of(?: the)?)?(?: gnu)?"
    for label, (keywords, name, version, identifier) in FAMILIES.items():
        tail = rf"{_V} {version}" if version else ""
        add(0, 1.0, label, identifier.split()[0] + " spdx", rf"spdx licen[cs]e identifier {identifier}(?: only| or later)?")
        add(2, 0.95, label, keywords, rf"{given} (?:{name}){tail}")
        add(3, 0.85, label, keywords, rf"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name}){tail}")
        add(4, 0.8, label, keywords, rf"(?:{name}){tail}(?: or (?:any )?later)?")
        add(4, 0.7, label, identifier.split()[0], rf"licen[cs]e {identifier}")
        add(4, 0.7, label, identifier.split()[0], rf"opensource org licenses {identifier}")
    for label, keywords, pattern in SENTENCES:
        add(1, 0.3 if label == "all-rights-reserved" else 0.98, label, keywords, pattern)
    for label, keywords, pattern in ADDRESSES:
        add(1, 0.9, label, keywords, pattern)
    for terms in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{terms.replace(' ', '-')}-{version.replace(' ', '.')}"
            add(1, 0.9, label, "creativecommons", rf"creativecommons org licenses {terms} {version}")
        add(5, 0.6, f"cc-{terms.replace(' ', '-')}", "cc", rf"cc {terms}")
    for label, keywords, pattern in [
        ("apache", "apache", r"apache(?: software)? licen[cs]e"), ("gpl", "gpl gnu", r"gnu general public licen[cs]e|gpl"),
        ("lgpl", "lgpl lesser", r"lgpl|lesser general public licen[cs]e"), ("agpl", "agpl affero", r"agpl|affero general public licen[cs]e"),
        ("mpl", "mozilla", r"mozilla public licen[cs]e"), ("epl", "eclipse", r"eclipse public licen[cs]e"),
        ("bsd", "bsd", r"bsd licen[cs]e|bsd style licen[cs]e"), ("creative-commons", "creative", r"creative commons(?: licen[cs]e)?"),
        ("artistic", "artistic", r"artistic licen[cs]e"), ("proprietary", "proprietary confidential", r"proprietary(?: and confidential)?(?: licen[cs]e| software)"),
    ]:
        add(6, 0.5, label, keywords, pattern)
    return found


def index() -> tuple[list[tuple[int, float, str, bytes]], dict[bytes, list[int]]]:
    """Rules as (priority, weight, label, pattern), and the numbers of the rules that a keyword opens."""
    known = rules()
    by_word: dict[bytes, list[int]] = {}
    for number, rule in enumerate(known):
        for word in rule.keywords:
            by_word.setdefault(word, []).append(number)
    return [(r.priority, r.weight, r.label, rf"(?<= )(?:{r.pattern})(?= )".encode()) for r in known], by_word


def scan(text: str | None, indexed) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Number of words; places (word, label) of the base phrases; accepted detections (start, end, label, weight)."""
    # bytes.lower() lower-cases A-Z alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()
    known, by_word = indexed
    present = by_word.keys() & words if len(words) < 64 else by_word.keys() & set(words)
    if not present:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    # Where the space before each word stands, and the last space.
    spaces = list(accumulate((len(word) + 1 for word in words), initial=0))
    places = []
    for phrase, label in BASE.items():
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            places.append((bisect_left(spaces, at), label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    detections = [
        (known[n][0], m.start() - m.end(), m.start(), m.end(), n)
        for n in sorted({n for word in present for n in by_word[word]}) for m in re.finditer(known[n][3], joined)]
    # The widest accepted spans; none holds another, so begins and ends both ascend.
    begins, ends, accepted = [], [], []
    for _, _, begin, end, n in sorted(detections):
        i = bisect_right(begins, begin)
        if i and ends[i - 1] >= end:
            continue
        accepted.append((begin, end, n))
        i = bisect_left(begins, begin)
        j = bisect_right(ends, end)
        begins[i:j], ends[i:j] = [begin], [end]
    return len(words), sorted(places), sorted(
        (bisect_left(spaces, a - 1), bisect_left(spaces, b), known[n][2], known[n][1]) for a, b, n in accepted)


_FOUND = ("n_words bigint, places array<struct<word: bigint, label: string>>,"
          " detections array<struct<first_word: bigint, end_word: bigint, label: string, weight: double>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, places, detections.

    ``places`` are the base phrases (word number and label); ``detections`` what the rules found and no wider
    or prior detection contains (words from ``first_word`` up to ``end_word``). Null counts as the empty
    text, which has none of either. Rows stay as they are, repeated ones too; other columns are ignored.
    """
    indexed = index()

    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [(n, [{"word": w, "label": x} for w, x in places],
              [{"first_word": a, "end_word": b, "label": x, "weight": w} for a, b, x, w in found])
             for n, places, found in (scan(t, indexed) for t in texts)], columns=["n_words", "places", "detections"])

    return docs.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")
