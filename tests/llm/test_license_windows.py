"""Licence notices that are no line, paragraph or text by themselves."""

from __future__ import annotations

import random
import textwrap

from weftline.llm import licenses

from .test_llm import docs_of


def test_notices_within_other_text(spark):
    t = licenses.TEMPLATES
    prose = "lorem ipsum of the dolor sit amet and this is some more text "
    block = lambda mark, *parts: f"\n{mark}\n".join("\n".join(f"{mark} {x}" for x in textwrap.wrap(p, 60)) for p in parts)
    texts = [
        "The MIT License\nCopyright 2020 Someone Else\n" + t[2][1] + " " + t[3][1] + " The software is provided as is, without warranty of any kind, express or implied.",
        "Released under the MIT License. Patches are welcome.",
        prose * 3 + "Released under the MIT License. " + prose * 3,
        block("#", "frobnicate.py - frobnicates things", "Copyright 2020 Someone", t[7][1], "See the file COPYING.") + "\nimport os\n" + prose,
        block(" *", "Copyright 2020 Someone", t[5][1]) + "\n" + prose,
        "\n".join(textwrap.wrap(t[16][1] + " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES " + prose, 50)),
        prose * 40,
        "Licensed under CC BY-NC-SA 4.0, " + prose,
        prose * 5 + "Licensed under the BSD 3-Clause License. " + prose * 5 + "Licensed under CC BY 4.0.",
    ]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    assert [got[k + 1]["best_license"] for k in range(7)] == ["MIT", "MIT", "MIT", "GPL-3.0", "Apache-2.0", "ISC", None]
    assert "CC-BY-NC-SA-4.0" in got[8]["licenses"] and got[8]["best_license"] == "CC-BY-NC-SA-4.0"
    assert {"BSD-3-Clause", "CC-BY-4.0"} <= set(got[9]["licenses"].split(","))
    assert got[3]["n_segments"] == 1 and got[3]["best_dice"] == 1.0


def test_whole_licences(spark):
    """Each licence's full text, with a copyright line, alone, in a header of comments and split by blank lines; BSD-2 apart from BSD-3."""
    full = {"MIT": licenses._MIT, "BSD-2-Clause": f"{licenses._BSD} {licenses._BSD_END}", "BSD-3-Clause": f"{licenses._BSD} {licenses._BSD_THIRD} {licenses._BSD_END}", "ISC": licenses._ISC, "Unlicense": licenses._UNLICENSE, "Zlib": licenses._ZLIB}
    texts, want = [], []
    for name, text in full.items():
        headed = f"Copyright (c) 2021, Some Body. All rights reserved.\n\n{text}"
        texts += [text, headed, "\n".join("# " + x for x in textwrap.wrap(headed, 70)), headed.replace(". ", ".\n\n")]
        want += [name] * 4
    long = "plain words of a very long text without any notice at all " * 30_000
    texts += [long, long + "\n\n" + licenses._ISC, "This project is licensed under the MIT License. " + "x " * 50]
    want += [None, "ISC", "MIT"]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    assert [got[k + 1]["best_license"] for k in range(len(texts))] == want
    assert all("BSD-3-Clause" not in got[k + 1]["licenses"] for k, w in enumerate(want) if w == "BSD-2-Clause")


def test_telling_words():
    """No set of bigrams that is enough for a hit is free of the telling words."""
    temps = licenses._templates(licenses.TEMPLATES)
    words = set(licenses.telling_words(temps, licenses.THRESHOLD))
    for _, _, b in temps:
        free = [x for x in b if not words & set(x.split(" "))]
        assert 2 * len(free) / (len(free) + len(b)) < licenses.THRESHOLD


def dice(words, template):
    g = {f"{a} {b}" for a, b in zip(words, words[1:])}
    b = set(licenses._bigrams(template))
    return 2 * len(g & b) / (len(g) + len(b))


def test_every_template_is_found_inside_other_text(spark):
    """Each template in a header of comments above varied code, within a line of prose, and with every twelfth word replaced."""
    r = random.Random(17)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(900)]
    code = lambda n: "\n".join(f"    {r.choice(names)} = {r.choice(names)}({r.choice(names)}, {r.randrange(99)})  # of the {r.choice(names)}" for _ in range(n))
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "in", "to", *r.sample(names, 9)]) for _ in range(n))
    texts, want = [], []
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        header = "\n".join(f"# {x}" for x in textwrap.wrap(f"{prose(12)} {text} {prose(9)}", 66))
        texts.append(f"{header}\n{code(400)}")
        texts.append(f"{prose(300)} {' '.join(text.split())} {prose(300)}")
        want += [name, name]
        words = licenses._words_of(text)
        if len(words) > 60:
            changed = [r.choice(names) if i % 12 == 7 else w for i, w in enumerate(words)]
            assert dice(changed, text) >= 0.8
            texts.append(f"{code(60)}\n{' '.join(changed)} {prose(200)}")
            want.append(name)
    got = {x["doc_id"]: x["licenses"].split(",") for x in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    assert [(k, w) for k, w in enumerate(want) if w not in got[k + 1]] == []


def test_several_windows_of_one_text(spark):
    """Copies of licences one behind the other, near and far, are windows of their own or one window that still reaches the threshold."""
    junk = lambda n: " ".join(f"x{i}" for i in range(n))
    texts = [f"{licenses._MIT} {junk(n)} {licenses._MIT} {junk(n)} {licenses._ISC} {junk(n)} {licenses._ZLIB}" for n in (0, 20, 60, 90, 400)]
    got = {x["doc_id"]: set(x["licenses"].split(",")) for x in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    assert all({"MIT", "ISC", "Zlib"} <= got[k + 1] for k in range(len(texts))), got


def test_repeated_rows_null_ids_and_ties(spark):
    line = "Released under the MIT License."
    docs = docs_of(spark, [line, line, line, None, ""], ids=[7, 7, None, None, 8])
    rows = sorted(map(tuple, licenses.digest(licenses.scan(docs)).collect()), key=repr)
    assert rows == sorted([(7, 1, "MIT", "MIT", 1.0)] * 2 + [(None, 1, "MIT", "MIT", 1.0), (None, 0, "", None, None), (8, 0, "", None, None)], key=repr)
    tied = (("A", "one two three four"), ("B", "four three one two"), ("C", "one two three four"))
    (x,) = licenses.scan(docs_of(spark, ["one two three four"]), templates=tied).collect()
    assert [(h["license"], h["dice"]) for h in x["hits"]] == [("A", 1.0), ("C", 1.0)]
    assert licenses.digest(licenses.scan(docs_of(spark, ["one two three four"]), templates=tied)).first()["best_license"] == "A"
