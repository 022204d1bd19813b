import hashlib
import os
import re

import pytest

from tidelake.llm import license_scan as s
from tidelake.llm.license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS


def canonical(text):
    lines = [x for x in (text or "").lower().split("\n")]
    out = []
    for line in lines:
        if re.match(r"[\W_]*(copyright|\(c\)|©)", line):
            continue
        form = " " + re.sub(r"[\W_]+", " ", line) + " "
        for old, new in SPELLINGS.items():
            form = form.replace(f" {old} ", f" {new} ")
        if form.strip():
            out.append(re.sub(" +", " ", form.strip()))
    return out


def test_against_brute_force(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    known = {}
    for k, t in [*TEXTS.items(), *((k, n) for k, ns in NOTICES.items() for n in ns)]:
        d = sha(" ".join(canonical(t)))
        known[d] = min(known.get(d, k), k)
    known |= {d: k for k, d in DIGESTS.items()}
    mit = TEXTS["MIT"]
    texts = [None, "", "plain", mit, "Copyright (c) 2020 A\n(C) B\n" + mit.upper().replace("SUBLICENSE", "sub-license"), mit.replace(". ", ".\n"), mit + "x", "a\nReleased under the MIT Licence!\nb\nreleased UNDER the mit license\nLicensed under CC BY-NC 4.0.", "x Released under the MIT License.", "\n\n ** Copyright 2001\n", "é ü\nLICENSED under the Apache License -- version 2.0"]
    rows = [(i, t, "clash", "y") for i, t in enumerate(texts)] + [(3, mit, "z", None), (None, "Licensed under CC BY 4.0", "z", None)]
    got = sorted((tuple(r) for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string, known string")).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        lines = canonical(t)
        hits = [known[sha(x)] for x in lines if sha(x) in known]
        d = sha(" ".join(lines))
        want.append((i, d, known.get(d), len(hits), ",".join(sorted(set(hits)))))
    assert got == sorted(want, key=str)
    assert [r[2] for r in got if r[0] in (3, 4)] == ["MIT"] * 3 and dict((r[0], r[2]) for r in got)[5] == "MIT"


def test_shuffled_lookup_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "our own terms"), (2, "other")], "doc_id long, text string")
    own = spark.createDataFrame([("Own", "Our own; terms."), (None, "other"), ("Null", None)], "license string, text string")
    for limit in (10_000, 0):
        monkeypatch.setattr(s, "BROADCAST_LICENSES", limit)
        assert {r.doc_id: r.text_license for r in s.scan(docs, own).collect()} == {1: "Own", 2: None}
    assert s.scan(docs.limit(0)).count() == 0
    assert s.scan(docs, own.limit(0)).where("text_license is not null").count() == 0


def test_whole_public_texts(spark):
    """Texts that Debian systems keep are known by digest, whatever their case and spacing."""
    folder = "/usr/share/common-licenses"
    files = {"GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files):
        pytest.skip("no licence texts here")
    rows = []
    for k, f in enumerate(files):
        with open(f"{folder}/{f}", encoding="utf-8") as lines:
            text = lines.read()
        rows += [(2 * k, text.upper().replace("\n", "\n   ")), (2 * k + 1, text + "\nand more")]
    got = {r.doc_id: r.text_license for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: name if i % 2 == 0 else None for k, name in enumerate(files.values()) for i in (2 * k, 2 * k + 1)}


def test_very_long_text(spark):
    text = "some words\n" * 200_000 + "Released under the MIT License.\n"
    assert s.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_notices == 1
