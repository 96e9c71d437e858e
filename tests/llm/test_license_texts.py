"""Whole licence texts and paragraphs, wrapped or not, against brute force."""

import random
import re
import textwrap

from sightline.llm import license_scan
from sightline.llm.license_scan import TEMPLATES, bigram_set, bounds, parts_of, scan_licenses


def expected(rows):
    out = []
    for doc_id, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        units = [("line", k, x) for k, x in enumerate(lines)]
        blocks = re.split(r"\n[ \t\r\n]*\n", text)
        if len(blocks) > 1:
            units += [("paragraph", k, x) for k, x in enumerate(blocks) if "\n" in x.strip(" ")]
        if len(lines) > 1:
            units.append(("text", -1, text))
        for unit, k, x in units:
            g = bigram_set(x)
            for name, texts in TEMPLATES.items():
                for v, t in enumerate(parts_of(texts)):
                    tg = bigram_set(t)
                    dice = 2 * len(g & tg) / max(1, len(g) + len(tg))
                    if dice >= license_scan.THRESHOLD:
                        out.append((doc_id, unit, k, name, v, len(g), round(dice, 6)))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.unit, r.line, r.license, r.variant, r["size"], r.dice) for r in df.collect())


def test_whole_texts(spark):
    mit, bsd = TEMPLATES["MIT"][3], TEMPLATES["BSD-3-Clause"][1]
    paragraph = mit.split("\n\n")[0]
    wrapped = lambda t, n=70: "\n\n".join("\n".join(textwrap.wrap(x, n)) for x in t.split("\n\n"))
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of", "software"]) + str(rng.randrange(50)) for _ in range(n))
    rows = [
        (1, paragraph), (2, f"{noise(30)}\n\n{wrapped(paragraph)}\n \n\n{noise(30)}"), (3, wrapped(mit)), (4, f"# {wrapped(bsd, 60)}"), (5, f"{noise(400)}\n\n{wrapped(bsd)}\n\n{noise(5000)}"),
        (6, "all rights reserved " * 1001), (7, None), (8, ""), (9, "\n\n\n"), (10, noise(20_000)), (11, "All rights reserved.\nAll rights reserved."), (11, "All rights reserved."), (None, mit.upper()),
        (12, noise(3) + "\n" + TEMPLATES["GPL-2.0"][0].replace("\n\n", "\n")), (13, " ".join(rng.sample(paragraph.split(), 60))),
    ]
    docs = spark.createDataFrame([(*r, "l", 1, 2) for r in rows], "doc_id long, text string, license string, size int, line int").repartition(4)
    got = found_with_null(scan_licenses(docs))
    assert got == sorted(expected([(-1 if k is None else k, t) for k, t in rows]))
    names = {(r[0], r[1], r[3]) for r in got}
    assert {(1, "line", "MIT"), (2, "paragraph", "MIT"), (3, "text", "MIT"), (4, "text", "BSD-3-Clause"), (5, "paragraph", "BSD-3-Clause"), (6, "line", "proprietary")} <= names
    assert not any(r[0] in (10, 13) for r in got)


def found_with_null(df):
    return found(df.fillna(-1, ["doc_id"]))


def test_bounds_are_exact():
    for size in range(1, 300):
        low, high = bounds(size, 0.8)
        assert all((2 * min(size, n) / (size + n) >= 0.8 - 1e-12) == (low <= n <= high) for n in range(1, 700))
