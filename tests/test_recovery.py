"""Hashes of broken programs: alike up to names and blanks, else different; edit distances; representations."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import code as C
from waymark.functions import recovery

PROGRAMS = [
    "import math\n\ndef area(side, kind=1):\n    # squares\n    total = side * side + kind\n    if total > 10:\n        print('big', total)\n    elif total < 3:\n        return 0\n    else:\n        total += 1\n    return total\n\nvalue = area(4)\nprint(value)\n",
    "class Box:\n    def put(self, item):\n        self.items.append(item)\n        for one in self.items:\n            print(one, end='')\n        try:\n            x = self.items[0]\n        except IndexError as err:\n            print(err)\n\nb = Box()\nb.put(\"a  b\")\n",
    "n = int(input('n'))\nrows = [\n    n,\n    n + 1,\n]\nwhile n > 0:\n    n -= 1\n    rows.append(n)\nprint(sum(rows), 2.5e3)\n",
]
#: What breaks a program: each takes the text and a line that it may break.
BREAKS = {
    "bracket": lambda lines, i: [*lines[:i], lines[i] + " (", *lines[i + 1 :]],
    "close": lambda lines, i: [*lines[:i], lines[i] + ")", *lines[i + 1 :]],
    "if": lambda lines, i: [*lines, "if:"],
    "quote": lambda lines, i: [*lines[:i], lines[i] + " 'open", *lines[i + 1 :]],
    "dollar": lambda lines, i: [*lines[:i], lines[i] + " $ ?", *lines[i + 1 :]],
    "else": lambda lines, i: ["else:", "    pass", *lines],
}
NAMES = ["area", "side", "kind", "total", "value", "item", "one", "x", "b", "n", "rows", "put"]


def renamed(text, seed):
    r = random.Random(seed)
    new = {n: f"q{r.randrange(10**6)}_{k}" for k, n in enumerate(NAMES)}
    return re.sub(r"(?<![\w.'\"])(" + "|".join(NAMES) + r")\b(?!['\"])", lambda m: new[m[1]], text)


def blanked(text, seed):
    """Other indents, blank lines, blanks around operators and comments; strings stay."""
    r, out = random.Random(seed), []
    for line in text.split("\n"):
        depth = (len(line) - len(line.lstrip(" "))) // 4
        bare = re.sub(r"([-+*<>=]=|[-+*=<>,])(?=[^'\"]*$)", lambda m: " " * r.randrange(3) + m[1] + " " * r.randrange(3), line.strip())
        out.append((" " * (2 if seed % 2 else 7) * depth + bare if bare else "") + ("  # note" if bare and r.random() < 0.3 and "'open" not in bare else "  "))
        if r.random() < 0.3:
            out.append("")
    return "\n".join(out)


def broken():
    for p, text in enumerate(PROGRAMS):
        lines = text.rstrip("\n").split("\n")
        spots = [i for i, line in enumerate(lines) if line.strip() and not line.strip().startswith(("#", "]", "n,", "n +", "rows = ["))]
        for kind, make in BREAKS.items():
            for i in spots if kind not in ("if", "else") else spots[:1]:
                if kind != "quote" or "#" not in lines[i]:
                    yield (p, kind, i), "\n".join(make(lines, i)) + "\n"


def test_broken_programs_by_brute_force():
    """Every break of every program: renamed and laid out anew it keeps its hash; no two breaks share one."""
    known = {}
    for key, text in broken():
        assert C.parsed(text) is None, (key, text)
        own = C.code_hash(text)
        assert C.code_hash(renamed(text, 1)) == own, text
        assert C.code_hash(blanked(text, 2)) == own == C.code_hash(blanked(renamed(text, 5), 3)), (text, blanked(text, 2))
        known.setdefault(own, []).append(key)
    assert all(len(v) == 1 for v in known.values()), [v for v in known.values() if len(v) > 1]
    assert len(known) == len(list(broken())) > 100 and not set(known) & {C.code_hash(p) for p in PROGRAMS}


def test_constants_attributes_and_strings_count():
    text = "def f(x:\n    y = x.size + 10\n    print('a b', y)\n"
    for a, b in ((".size", ".length"), ("10", "11"), ("a b", "a  b"), ("print('a b', y)", "print('a b', x)"), (" + ", " - ")):
        assert C.code_hash(text) != C.code_hash(text.replace(a, b)), a


def test_the_parts_that_parse_are_trees():
    form = C.normal_form("a = 1\nb = (a\nc = b\nd = c\n", C._Rename(), str, str)
    assert [x[0] for x in form] == ["run", "line", "run"] and len(form[2]) == 3
    form = C.normal_form("try:\n    a = 1\nexcept:\n    b = (\nc = 2\n", C._Rename(), str, str)
    assert form[0][:3] == ["line", "try", ":"] and form[0][3][0][0] == "run" and form[1][:3] == ["line", "except", ":"] and form[2][0] == "run"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \n\t()[]:'\"#\\=+.ifdefé$", max_size=60))
def test_any_text_has_a_form(text):
    """Nothing is lost: the tokens of the lines are the text without blanks and comments."""
    lines = recovery.logical_lines(text)
    assert C.code_hash(text) == C.code_hash(text) and all(line.first <= line.last for line in lines)
    bare = lambda parts: re.sub(r"\s", "", "".join(parts))
    flat = bare(t for line in lines for _, t in line.tokens)
    kept = bare(m[0] for m in recovery._TOKEN.finditer(text + "\n") if m.lastgroup not in ("comment", "blank", "newline", "join"))
    assert flat == kept


def test_deep_and_long_broken_texts():
    deep = "".join("  " * i + "if x\n" for i in range(400))
    assert len(C.code_hash(deep)) == 32 and len(C.code_hash("(" * 5000)) == 32
    assert C.code_hash("x = (\n" * 3000) != C.code_hash("x = (\n" * 2999)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert C.edit_distance(a, b) == row[-1]


def test_representation_strategies(spark):
    a = "a\nb\nc\nd\ne\nf"
    rows = [(None, a, False), ("", a, False), (a, a.replace("c", "x"), True), (a, "q w", False), (a, None, False), (a, a.replace("a", "1").replace("f", "2"), None)]
    df = spark.createDataFrame(rows, "p string, n string, g boolean").coalesce(1)
    shown = df.select(*(C.shown_as(F.col("p"), F.col("n"), s, F.col("g")).alias(s) for s in ("one_block", "content_diff", "progression"))).collect()
    assert [tuple(r) for r in shown] == [("full",) * 3, ("full",) * 3, ("diff", "diff", "full"), ("full", "full", "diff"), (None,) * 3, ("full", "diff", "diff")]
    with pytest.raises(ValueError):
        C.representation(a, a, "other")
