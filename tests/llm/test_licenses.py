import re

from quaestor.llm import license_rules
from quaestor.llm.license_rules import rules
from quaestor.llm.licenses import BASE, license_scan

SEP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, labels string, n_words long"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SEP.findall(low)
    at, found = [], set()
    for phrase, label in BASE:
        p = phrase.split(" ")
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        if hits:
            found.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)), brute_labels(words) | found


def brute_labels(words):
    numbered = "".join(f" {w}:{i}" for i, w in enumerate(words))
    dets = []
    for order, label, rank, keyword, pattern in rules():
        if keyword not in words:
            continue
        for m in re.finditer(pattern, numbered):
            n = [int(x) for x in re.findall(r":(\d+)(?= |$)", m.group(0))]
            dets.append((n[0], n[-1], rank, order, label))
    kept = set()
    for a in dets:
        inside = any(b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and (b[:2] != a[:2] or (b[2], b[3]) < (a[2], a[3])) for b in dets)
        if not inside:
            kept.add(a[4])
    return kept


TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "mit license MIT\n\nLicense; mit-license mit licenses",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-only and general public license",
    "éMIT License and İmit license K mit license",
    "submit license, the general\tpublic license applies",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License",
    "word " * 30000 + "MIT License " * 500,
    "Creative Commons Attribution-ShareAlike 4.0 International License",
]


def test_matches_brute_force(spark):
    rows = [(i, t, "en", "x", 7) for i, t in enumerate(TEXTS)] + [(None, "MIT License", None, None, None), (2, TEXTS[2], "en", "x", 7)]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        n, k, first, last, base, labels = brute(t)
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, base), t
        assert r.labels == ",".join(sorted(labels)), t
        assert 0 <= r.score <= 1
    assert by[None].base_labels == "mit"
    assert by[5].labels == "gpl,gpl-3.0"
    assert by[4].labels == "apache,apache-2.0,cc-by-nc-4.0"


def test_rules_compile_and_hold_their_keyword():
    table = rules()
    assert len(table) > 250
    for _, _, rank, keyword, pattern in table:
        re.compile(pattern)
        assert keyword in pattern and 1 <= rank <= 5


def alternatives(pattern):
    """Patterns without top-level alternatives: a pattern's groups of alternatives are written out, one at a time."""
    depth, start, cuts = 0, None, []
    for i, c in enumerate(pattern):
        if c == "(":
            start, cuts = (i, [i + 2]) if depth == 0 else (start, cuts)
            depth += 1
        elif c == "|" and depth == 1:
            cuts.append(i)
        elif c == ")":
            depth -= 1
            if depth == 0:
                after = pattern[i + 1 :]
                optional = after.startswith("?")
                parts = [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i])]
                for part in [*parts, ""] if optional else parts:
                    yield from alternatives(pattern[:start] + part + after[optional:])
                return
    yield pattern


def test_each_alternative_holds_its_keyword():
    # A text of "zero clause bsd" is found by the rule after the one of 0bsd.
    covered = {("0bsd", "zero clause bsd")}
    bad = set()
    for line in license_rules._HAND.strip().splitlines():
        label, _, keyword, pattern = (x.strip() for x in line.split("|", 3))
        for one in alternatives(pattern):
            # A gap of any words, and optional letters, which are no part of what each match holds.
            words = re.sub(r"\[[^\]]*\]", "?", re.sub(r"\.\{0,\d+\}\??", " ", one))
            if keyword not in re.findall(r"[^ ]+", words):
                bad.add((label, one))
    assert bad == covered


def test_end_user_agreement_without_its_short_name(spark):
    texts = ["Read the End User License Agreement first.", "end-user licence agreement", "the EULA", "end user agreement"]
    rows = [(i, t, "en", "x", 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].labels for i in range(4)] == ["proprietary", "proprietary", "proprietary", ""]
    assert [got[i].n_detections for i in range(4)] == [1, 1, 1, 0]


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
