"""Licences with words put in or changed, against the best Dice of all passages."""

from __future__ import annotations

import random

import pyarrow as pa

from quillstone.llm import license_scan
from quillstone.llm.common import text_bytes
from quillstone.llm.decontamination import words_of


def found(texts, templates=license_scan.TEMPLATES):
    column = text_bytes(pa.array(texts))
    return {(i, name): d for i, name, d, _, _ in license_scan.Templates(templates).find(column, 0, len(texts))}


def brute(text, templates):
    words, out = words_of(text), {}
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            own = license_scan.bigrams(words[i:j])
            for name, t in templates:
                b = license_scan.bigrams(words_of(t))
                d = 2 * len(own & b) / (len(own) + len(b))
                if d >= license_scan.DICE - 1e-9:
                    out[name] = max(d, out.get(name, 0.0))
    return out


def test_clauses_put_in():
    for put in ("by Jane Doe", "a clause of its own that nobody else has"):
        cases = []
        for name, t in license_scan.TEMPLATES:
            words = t.split()
            if len(words) > 30:
                cases += [(name, " ".join(["before this", *words[:k], put, *words[k:], "and after"])) for k in (len(words) // 3, len(words) // 2, 2 * len(words) // 3)]
        got = found([t for _, t in cases])
        assert [i for i, (name, _) in enumerate(cases) if (i, name) not in got] == []


def test_all_passages_by_brute_force():
    templates = (("A", "one two three four five six seven eight nine ten eleven twelve"), ("B", "three four five red green blue"), ("C", "one two one two three one"))
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [w for w in rng.choice(templates)[1].split() if rng.random() > 0.08]
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(words) + 1)
                words[at:at] = [rng.choice(("x", "y", "z", "one", "four"))] * rng.randrange(1, 5)
        texts.append(" ".join(words))
    got = found(texts, templates)
    want = {(i, name): d for i, t in enumerate(texts) for name, d in brute(t, templates).items()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_whole_texts():
    """Each steward's whole text inside other words, as it is and with holders, clauses and changed words, is found as itself; a part of it far under the threshold is not."""
    rng = random.Random(8)
    full = license_scan.full_texts()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= {n for n, _ in full}
    texts = []
    for _, t in full:
        words = t.split()
        changed = [w if rng.random() > 0.02 else "changed" for w in words]
        put = words[: len(words) // 2] + "copyright by Jane Doe and all the contributors of this project".split() + words[len(words) // 2 :]
        texts += [" ".join(w) for w in (["intro", *words, "outro"], changed, put, words[: len(words) // 3])]
    templates = (*license_scan.TEMPLATES, *full)
    got = found(texts, templates)
    for i, (name, t) in enumerate(full):
        for k in range(3):
            d = got[4 * i + k, name]
            assert d > (0.9 if k else 0.999) and d == max(x for (j, _), x in got.items() if j == 4 * i + k)
        if len(t.split()) > 400:
            assert not {n for j, n in got if j == 4 * i + 3} & {name}


def test_counts_prune_nothing():
    """Against every passage compared with every template, texts mixed from the notices' own words."""
    rng = random.Random(11)
    templates = tuple((n, t) for n, t in license_scan.TEMPLATES if len(t.split()) < 20)
    pool = [w for _, t in templates for w in t.split()]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [w if rng.random() > 0.1 else rng.choice(pool) for w in rng.choice(templates)[1].split()] + rng.choices(pool, k=rng.randrange(0, 6))
        texts.append(" ".join(words))
    got = found(texts, templates)
    want = {(i, n): d for i, t in enumerate(texts) for n, d in brute(t, templates).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 60
