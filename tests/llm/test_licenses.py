import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.licenses import BODY, TEMPLATES, WORD, Scanner, align, all_templates, increasing, scan_licenses, templates_of

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh")), st.lists(st.sampled_from("abcdefgh")))
def test_alignment_is_increasing_and_equal(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    assert align(a, a) == [(i, i) for i in range(len(a))]


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(8)))
def test_longest_increasing(order):
    best = [1] * 8
    for n in range(8):
        best[n] = 1 + max([best[k] for k in range(n) if order[k] < order[n]], default=0)
    assert len(increasing(list(enumerate(order)))) == max(best)


def test_finds_notices_wherever_they_stand():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["the", "under", "license", "version"]
    scanner = Scanner(TEMPLATES)
    for name, notice in NOTICES.items():
        for _ in range(20):
            before, after = (" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(2))
            text = f"{before}\n{notice.upper() if rng.random() < 0.3 else notice}\n{after}\n{notice}"
            found = [m for m in scanner.scan(text) if m[0] == name]
            assert len(found) == 2
            low = text.lower()
            assert all(SequenceMatcher(None, WORD.findall(low[s:e]), WORD.findall(notice.lower())).ratio() > 0.85 for _, s, e, _ in found)
    assert scanner.scan(" ".join(rng.choices(words, k=5000))) == []


def test_full_templates_and_altered_ones():
    scanner = Scanner(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert any(m[0] == name and m[3] == 1 for m in scanner.scan(f"before {t} after")), (name, t)
            words = t.split()
            if len(words) > 12:
                words[5:6] = ["well", "now"]
                assert name in {m[0] for m in scanner.scan(" ".join(words))}


def test_words_put_into_a_notice():
    scanner = Scanner(TEMPLATES)
    one = "Licensed under the Apache License by Example Corporation of Springfield Illinois, Version 2.0"
    assert [(m[0], m[3]) for m in scanner.scan(f"before {one} after")] == [("Apache-2.0", 1)]
    assert [(m[0], m[3]) for m in scanner.scan(f"{one}. {one}.")] == [("Apache-2.0", 1)] * 2
    for name, texts in TEMPLATES.items():
        for t in texts:
            # as many words as the template has, in one place or spread over it
            words = WORD.findall(t)
            for at in (1, len(words) // 2, len(words) - 1):
                put = words[:at] + ["zz"] * len(words) + words[at:]
                assert (name, 1) in {(m[0], m[3]) for m in scanner.scan(" ".join(["so", *put, "on"]))}, (t, at)


def test_words_of_other_kinds_in_any_number():
    """Forty or more foreign words at a place; at a gap beyond the bound a notice ends."""
    scanner = Scanner(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            for at, n in ((len(words) // 2, 40), (1, 60), (len(words) - 1, 64)):
                put = words[:at] + [f"zz{i}" for i in range(n)] + words[at:]
                assert (name, 1) in {(m[0], m[3]) for m in scanner.scan(" ".join(["so", *put, "on"]))}, (t, at)
            spread = [x for w in words for x in (w, *(f"q{i}" for i in range(9)))]
            assert (name, 1) in {(m[0], m[3]) for m in scanner.scan(" ".join(spread))}, t
    mit = TEMPLATES["MIT"][0].split()
    assert scanner.scan(" ".join([*mit[:3], *["zz"] * 65, *mit[3:]])) == []
    assert Scanner(TEMPLATES, gap=100).scan(" ".join([*mit[:3], *["zz"] * 65, *mit[3:]])) != []


def test_the_name_of_a_license_must_stand_there():
    scanner = Scanner(all_templates())
    for text in ("Released under the BSD License", "Released under the old License", "This work is licensed under the GNU General Public License, version 7", "Licensed under the Apache License, Version 1.1", "Licensed under CC BY 3.0"):
        assert scanner.scan(text) == [], text
    assert [m[0] for m in scanner.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert [m[0] for m in scanner.scan("This library is licensed under the GNU Lesser General Public License, version 2.1 only")] == ["LGPL-2.1"]


def test_places_are_those_of_the_text_itself():
    # a capital whose lower case is two code points
    text = "\u0130\u0130\u0130 x " + NOTICES["MIT"] + " \u0130"
    [(name, start, end, coverage)] = Scanner(TEMPLATES).scan(text)
    assert (name, coverage, text[start:end]) == ("MIT", 1, "Released under the MIT License")


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def test_altered_bodies_against_the_longest_common_subsequence():
    """Coverage never exceeds the best alignment and comes close to it."""
    rng = random.Random(6)
    templates = all_templates()
    scanner = Scanner(templates)
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib"):
        body = templates[name][-1]
        template = WORD.findall(body.lower())
        assert len(template) >= BODY
        filler = " ".join(f"f{rng.randint(0, 99)}" for _ in range(300))
        assert [(m[0], m[3]) for m in scanner.scan(f"{filler} {body} {filler}")] == [(name, 1)]
        for _ in range(10):
            words = [w for w in template if rng.random() > 0.04]
            for _ in range(8):
                at = rng.randint(0, len(words))
                words[at:at] = [rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randint(1, 25))]
            words = [rng.choice(["xx", "yy"]) if rng.random() < 0.04 else w for w in words]
            found = [m for m in scanner.scan(f"{filler} {' '.join(words)} {filler}") if m[0] == name]
            best = longest_common(words, template) / len(template)
            assert len(found) == 1 and best - 0.03 <= found[0][3] <= best + 1e-9, (name, best, found)


def test_bodies_of_a_folder(tmp_path):
    rng = random.Random(7)
    words = [f"k{i}" for i in range(3000)]
    long = rng.choices(words, [1 / (i + 5) for i in range(3000)], k=5000)
    (tmp_path / "Long-1.0").write_text(" ".join(long))
    (tmp_path / "Short-1.0.txt").write_text("Given away under the short license 1.0")
    (tmp_path / "notes.md").write_text("no license")
    templates = templates_of(tmp_path)
    assert sorted(templates) == ["Long-1.0", "Short-1.0"]
    scanner = Scanner(templates)
    noise = lambda n: rng.choices(words, [1 / (i + 5) for i in range(3000)], k=n)
    text = [*noise(7000), *long[:2500], *["zz"] * 700, *long[2500:], *noise(3000)]
    [(name, start, end, coverage)] = scanner.scan(" ".join(text))
    assert name == "Long-1.0" and coverage > 0.99 and " ".join(text)[start:end].split()[:5] == long[:5]
    assert scanner.scan(" ".join(noise(20_000))) == []


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, NOTICES["MIT"]), (4, NOTICES["MIT"]), (5, "mit " * 50_000)]
    got = scan_licenses(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, matches int")).collect()
    assert [[m.license for m in r.matches] for r in got] == [[], [], [], ["MIT"], ["MIT"], []]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
