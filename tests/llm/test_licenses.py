import random
import textwrap

import pytest

from barloom.llm import licenses

DETECTOR = licenses.Detector()
rnd = random.Random(5)
PROSE = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(900)]


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(PROSE) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def told(text):
    return [(x.license, text[x.start : x.end]) for x in DETECTOR.find(text)]


@pytest.mark.parametrize("name, notice", licenses.TEMPLATES)
def test_a_notice_in_varied_prose_on_one_line(name, notice):
    for seed, n in enumerate((0, 5, 50, 120, 200, 2000)):
        text = f"{prose(n, seed)} {notice} {prose(n, seed + 100)}"
        (found,) = told(text)
        assert found[0] == name and notice.startswith(found[1]) and len(notice) - len(found[1]) <= 2


@pytest.mark.parametrize("name, notice", licenses.TEMPLATES)
def test_a_notice_below_copyright_lines_and_wrapped(name, notice):
    above = "".join(f"Copyright {1990 + k} {prose(3, k)}\n" for k in range(12))
    for text in (above + notice, above + textwrap.fill(notice, 40), above + textwrap.fill(notice, 72, initial_indent=" * ", subsequent_indent=" * ")):
        assert [x for x, _ in told(text)] == [name]


def test_notices_far_apart_and_side_by_side_on_one_line():
    short = [t for t in licenses.TEMPLATES if len(t[1]) < 100]
    for n in (0, 30, 300):
        text = " ".join(f"{notice} {prose(n, k)}" for k, (_, notice) in enumerate(short + short))
        assert [x for x, _ in told(text)] == [x for x, _ in short + short]


def test_other_words_may_differ_but_telling_ones_not():
    text = f"{prose(300, 1)} this work is licensed under the GNU General Public License, version 2. And the work is licensed under the GNU General Public License version 3 {prose(300, 2)}"
    assert [x for x, _ in told(text)] == ["GPL-2.0", "GPL-3.0"]
    assert DETECTOR.find(text)[1].differences == ("-this",)
    assert told(f"{prose(100, 1)} Licensed under the Apache License, Version 1.1. {prose(100, 2)}") == []
    assert told("Licensed under the Apache Software Foundation License, Version 2.0.") == []
