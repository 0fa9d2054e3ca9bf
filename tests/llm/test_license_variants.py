"""Licenses that read alike are told apart, and the prefilter loses no match."""

import random

import pyarrow as pa

from lakemart.llm import licenses
from lakemart.llm.common import Words
from lakemart.llm.license_texts import TELLING, TEMPLATES

from .cases import documents, prose


def scan(texts):
    own = [licenses.Template(k, v, licenses.COVERAGE, TELLING.get(k, ())) for k, v in sorted(TEMPLATES.items())]
    return [[m["license"] for m in found] for found in licenses.scan_block(pa.array(texts, pa.string()), own)]


def test_each_template_is_found_under_its_name():
    names = sorted(TEMPLATES)
    assert {"GPL-3-text", "LGPL-2.1-text", "Apache-2.0-text", "MPL-2.0-text", "AGPL-3.0-header", "BSD-3-Clause"} <= set(names)
    got = scan([f"{prose(k, 40)}\n{TEMPLATES[n]}\n{prose(k + 99, 40)}" for k, n in enumerate(names)])
    assert {n: g for n, g in zip(names, got, strict=True) if n not in g} == {}
    # but for full texts that hold notices of others before or after them, nothing else is
    assert all(g == [n] for n, g in zip(names, got, strict=True) if not n.endswith("-text"))


def test_variants_do_not_match():
    header = TEMPLATES["GPL-3.0-header"]
    assert scan([
        "Released under the BSD License.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        "This work is licensed under the GNU General Public License, version 1.", header.replace("version 3", "version 9"),
        header.replace("General", "Fictional General"), TEMPLATES["MPL-2.0"].replace("v. 2.0.", "v. 1.0."),
    ]) == [[]] * 8


def test_variants_match_their_own():
    header = TEMPLATES["GPL-3.0-header"]
    university = TEMPLATES["BSD-3-Clause"].replace("the copyright holder", "the University")
    assert scan([
        header.replace("version 3", "version 2"), header.replace("General", "Lesser General"), header.replace("General", "Affero General"),
        university, "Distributed under the MIT License.", "This work is licensed under the GNU General Public License v3.",
        "Released under the BSD License. Released under the MIT License.", "Licensed under the Apache License 2.0.",
    ]) == [["GPL-2.0-header"], ["LGPL-3.0-header"], ["AGPL-3.0-header"], ["BSD-3-Clause"], ["MIT"], ["GPL-3.0"], ["MIT"], ["Apache-2.0"]]


def test_prefilter_loses_nothing():
    rng = random.Random(5)
    for name, text in sorted(TEMPLATES.items()):
        if name.endswith("-text") and len(text) > 2000:
            continue
        t = licenses.Template(name, text, licenses.COVERAGE)
        words = text.split()
        for _ in range(40):
            held = Words(pa.array([" ".join(w for w in words if rng.random() < 0.8)], pa.string()), licenses.WORD).key.tolist()
            assert t.possible(set(held)) or len(licenses.align(held, t.words)) < licenses.COVERAGE * len(t.words)


def test_long_words_may_be_missed(spark):
    # five of the eight long words are gone, which coverage allows
    text = "alphas bravos charly deltas echoes foxtro golfes hotels " + " ".join(f"w{k}" for k in range(20))
    held = text.split(" ", 5)[-1]
    got = licenses.scan(documents(spark, [(1, f"qqq {held} zzz", None, None)]), {"x": text}).collect()
    assert [m["license"] for m in got[0]["found"]] == ["x"]
