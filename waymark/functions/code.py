"""Functions on program texts that need Python: Arrow-batched pandas UDFs.

Each plain function is usable by itself; ``udf(name)`` wraps it for columns.  Null
arguments give null except where a function says otherwise.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import io
import json
import keyword
import math
import re
import sys
import token as tokens
import tokenize
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship
from .recovery import normal_form

#: Least ratio of a fuzzy line match, and its penalty for each line of distance.
FUZZY, NEAR = 0.90, 0.01
#: Characters of arguments and results that a function keeps in a task.
HELD = 1 << 22


# --- normal forms -----------------------------------------------------------


class _Rename(ast.NodeTransformer):
    """Variables and functions by order of first appearance; everything else stays."""

    def __init__(self) -> None:
        self.variables: dict[str, str] = {}
        self.functions: dict[str, str] = {}

    def _of(self, names: dict[str, str], kind: str, name: str) -> str:
        return names.setdefault(name, f"{kind}{len(names)}")

    def visit_Name(self, node):
        node.id = self._of(self.variables, "v", node.id)
        return node

    def visit_arg(self, node):
        node.arg = self._of(self.variables, "v", node.arg)
        return node

    def visit_FunctionDef(self, node):
        node.name = self._of(self.functions, "f", node.name)
        return self.generic_visit(node)


@contextmanager
def _deep():
    """Room for syntax trees as deep as the parser itself allows; a walk over one takes a few
    frames a level, which live on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 100_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parsed(code: str) -> ast.Module | None:
    """The syntax tree, null if the text doesn't parse or is nested deeper than the parser goes."""
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def code_hash(code: str) -> str:
    """MD5 of the renamed syntax tree; '' for ''.

    A text that doesn't parse is hashed in the normal form of ``recovery``: what of it parses as
    renamed trees, the rest as tokens with names replaced.  Only one nested deeper than
    Python goes is hashed as it is.  Equal hashes mean equal programs up to names, within
    one Python version; a broken program never shares its hash with one that parses.
    """
    if not code:
        return ""
    tree, form = parsed(code), code
    with _deep(), suppress(RecursionError):
        rename = _Rename()
        if tree is not None:
            form = ast.dump(rename.visit(tree))
        else:
            form = json.dumps(normal_form(code, rename, lambda n: rename._of(rename.variables, "v", n), lambda n: rename._of(rename.functions, "f", n)))
    return hashlib.md5(form.encode("utf-8", "replace")).hexdigest()


def compiles(code: str) -> bool:
    return parsed(code) is not None


def reprinted(code: str) -> str | None:
    """The program in one canonical layout, null if it doesn't parse."""
    tree = parsed(code)
    with _deep(), suppress(RecursionError):
        return None if tree is None else ast.unparse(tree)
    return None


# --- tokens -----------------------------------------------------------------


def _tokens(code: str, drop: set[int]) -> list[str] | None:
    try:
        return [t.string for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in drop]
    except (tokenize.TokenError, SyntaxError, ValueError):
        return None


def tokens_with_comments(code: str) -> list[str] | None:
    """Tokens without line and indent marks; null if the text can't be tokenised."""
    return _tokens(code, {tokens.NEWLINE, tokens.NL, tokens.INDENT, tokens.DEDENT, tokens.ENDMARKER})


def tokens_with_indents(code: str) -> list[str]:
    """Tokens without line marks and comments; none if the text can't be tokenised."""
    return _tokens(code, {tokens.NEWLINE, tokens.NL, tokens.COMMENT, tokens.ENDMARKER}) or []


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences of hashable items.

    One integer holds a column of differences, a bit a row (Myers 1999, in Hyyrö's form), so
    an item of b costs a few operations on numbers of len(a) bits.
    """
    if not a or not b:
        return len(a) or len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for y in b:
        equal = where.get(y, 0)
        level = (((equal & up) + up) ^ up) | equal | down
        right, left = down | (full & ~(level | up)), up & level
        distance += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(level | right)), right & level
    return distance


def token_distance(a: str, b: str) -> float:
    """Distance over the longer token list; 1 if either doesn't compile or has no tokens."""
    if not compiles(a) or not compiles(b):
        return 1.0
    x, y = tokens_with_indents(a), tokens_with_indents(b)
    return 1.0 if not x or not y else edit_distance(x, y) / max(len(x), len(y))


def token_edits(a: str, b: str) -> float:
    return float(edit_distance(tokens_with_indents(a), tokens_with_indents(b)))


def token_edits_over_source(a: str, b: str) -> float | None:
    """``token_edits`` over the first program's tokens; null if it has none."""
    n = len(tokens_with_indents(a))
    return token_edits(a, b) / n if n else None


def token_similarity(a: str, b: str) -> float:
    """Matching ratio of tokens, of plain words where either can't be tokenised."""
    x, y = tokens_with_comments(a), tokens_with_comments(b)
    if x is None or y is None:
        x, y = re.findall(r"\w+", a), re.findall(r"\w+", b)
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def closest(word: str, known: list[str]) -> str | None:
    """The known word of greatest matching ratio, the first of several."""
    return max(known, key=lambda k: difflib.SequenceMatcher(None, word, k).ratio(), default=None)


# --- trees ------------------------------------------------------------------


def _postorder(root: ast.AST) -> tuple[list[str], list[int]]:
    """(labels of all nodes, index of each node's leftmost leaf), children before parents."""
    labels, leftmost = [], []
    walk = [(root, ast.iter_child_nodes(root), None)]
    while walk:
        node, children, first = walk.pop()
        child = next(children, None)
        if child is not None:
            walk += [(node, children, first), (child, ast.iter_child_nodes(child), None)]
            continue
        labels.append(type(node).__name__)
        leftmost.append(len(labels) - 1 if first is None else first)
        if walk and walk[-1][2] is None:
            walk[-1] = (*walk[-1][:2], leftmost[-1])
    return labels, leftmost


def tree_edits(a: str, b: str) -> float | None:
    """Zhang-Shasha distance of the syntax trees; null if either doesn't parse."""
    s, t = parsed(a), parsed(b)
    if s is None or t is None:
        return None
    return float(_shape_edits(*(tuple(x) for tree in (s, t) for x in _postorder(tree))))


@lru_cache(maxsize=512)
def _shape_edits(la: tuple[str, ...], ia: tuple[int, ...], lb: tuple[str, ...], ib: tuple[int, ...]) -> int:
    """Of two trees as ``_postorder`` gives them: names and constants play no part, so shapes recur."""
    roots = lambda left: sorted({v: k for k, v in enumerate(left)}.values())
    out = [[0] * len(lb) for _ in la]
    for i in roots(ia):
        for j in roots(ib):
            di, dj = ia[i], ib[j]
            forest = [[0] * (j - dj + 2) for _ in range(i - di + 2)]
            for x in range(1, i - di + 2):
                forest[x][0] = x
            for y in range(1, j - dj + 2):
                forest[0][y] = y
            for x in range(1, i - di + 2):
                for y in range(1, j - dj + 2):
                    p, q = di + x - 1, dj + y - 1
                    edge = min(forest[x - 1][y], forest[x][y - 1]) + 1
                    if ia[p] == di and ib[q] == dj:
                        forest[x][y] = min(edge, forest[x - 1][y - 1] + (la[p] != lb[q]))
                        out[p][q] = forest[x][y]
                    else:
                        forest[x][y] = min(edge, forest[ia[p] - di][ib[q] - dj] + out[p][q])
    return out[-1][-1]


def tree_edits_over_source(a: str, b: str) -> float | None:
    """``tree_edits`` over the first program's tree."""
    d = tree_edits(a, b)
    return None if d is None else d / tree_size(a)


def tree_size(code: str) -> float | None:
    tree = parsed(code)
    return None if tree is None else float(sum(1 for _ in ast.walk(tree)))


def tree_distance(a: str, b: str) -> float | None:
    """``tree_edits`` over the larger tree."""
    d = tree_edits(a, b)
    return None if d is None else d / max(tree_size(a), tree_size(b))


# --- n-gram scores ----------------------------------------------------------


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n))))


def bleu(reference: list[str], answer: list[str], order: int = 4, weights: dict[str, float] | None = None) -> float:
    """Smoothed BLEU of token lists; ``weights`` counts unigrams unequally."""
    if not reference or not answer:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        want, have = _grams(reference, n), _grams(answer, n)
        weigh = (lambda g: weights.get(g[0], 0.2)) if weights is not None and n == 1 else (lambda g: 1.0)
        total = sum(weigh(g) * c for g, c in have.items())
        hit = sum(weigh(g) * min(c, want[g]) for g, c in have.items())
        if n > 1:
            hit, total = hit + 1, total + 1
        if not hit or not total:
            return 0.0
        logs += math.log(hit / total) / order
    return math.exp(logs + min(0.0, 1 - len(reference) / len(answer)))


def bleu_distance(a: str, b: str) -> float:
    return 1.0 - bleu(a.split(), b.split())


def rouge_distance(a: str, b: str, n: int = 1) -> float:
    """1 - F1 of n-gram overlap; n = 0 takes the longest common subsequence."""
    x, y = a.split(), b.split()
    if n:
        want, have = _grams(x, n), _grams(y, n)
        hit, p, r = sum((want & have).values()), sum(have.values()), sum(want.values())
    else:
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        hit, p, r = row[-1], len(y), len(x)
    return 1.0 - (2 * hit / (p + r) if hit else 0.0)


def rouge2_distance(a: str, b: str) -> float:
    return rouge_distance(a, b, 2)


def rouge_l_distance(a: str, b: str) -> float:
    return rouge_distance(a, b, 0)


def _union_lcs(line: list[str], others: list[list[str]]) -> set[int]:
    """Positions of a line that lie on its longest common subsequence with any other line."""
    hit: set[int] = set()
    for other in others:
        table = [[0] * (len(other) + 1) for _ in range(len(line) + 1)]
        for i, x in enumerate(line, 1):
            for j, y in enumerate(other, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        i, j = len(line), len(other)
        while i and j:
            if line[i - 1] == other[j - 1]:
                hit.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
    return hit


def rouge_lsum_distance(a: str, b: str) -> float:
    """1 - F1 of the union of longest common subsequences, line by line; a word of either
    side counts at most as often as the other side has it."""
    want, have = ([line.split() for line in t.split("\n") if line.strip()] for t in (a, b))
    left, right = Counter(w for line in want for w in line), Counter(w for line in have for w in line)
    p, r, hits = right.total(), left.total(), 0
    for line in want:
        for i in sorted(_union_lcs(line, have)):
            if left[line[i]] > 0 and right[line[i]] > 0:
                hits += 1
                left[line[i]] -= 1
                right[line[i]] -= 1
    return 1.0 - (2 * hits / (p + r) if hits else 0.0)


def _subtrees(tree: ast.AST) -> Counter:
    """How often each shape of a subtree occurs; a shape is its node's kind over its children's."""
    labels, leftmost = _postorder(tree)
    shapes: list[bytes] = []
    roots: list[int] = []  # subtrees that no parent has taken yet
    for i, label in enumerate(labels):
        own = []
        while roots and roots[-1] >= leftmost[i]:
            own.append(shapes[roots.pop()])
        shapes.append(hashlib.blake2b(label.encode() + b"(" + b",".join(own[::-1]) + b")", digest_size=16).digest())
        roots.append(i)
    return Counter(shapes)


def _flows(tree: ast.AST) -> Counter:
    """Edges of data flow: assigned name <- read name, names by order of appearance."""
    names: dict[str, int] = {}
    number = lambda n: names.setdefault(n, len(names))
    out: Counter = Counter()
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign | ast.For):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            value = node.iter if isinstance(node, ast.For) else node.value
            reads = [n.id for n in ast.walk(value) if isinstance(n, ast.Name)] if value is not None else []
            for t in (n.id for target in targets for n in ast.walk(target) if isinstance(n, ast.Name)):
                for r in reads or ["\0"]:
                    out[(number(t), number(r))] += 1
    return out


def codebleu_parts(reference: str, answer: str) -> dict[str, float]:
    """BLEU, keyword-weighted BLEU, subtree and data-flow match of two programs.

    By the published definition with Python's own parser; scores are comparable with
    each other, not with those of other implementations.  All 0 for an empty side.
    """
    if not reference or not answer:
        return dict.fromkeys(("ngram", "weighted", "tree", "flow"), 0.0)
    x = tokens_with_indents(reference) or reference.split()
    y = tokens_with_indents(answer) or answer.split()
    weights = {k: 1.0 for k in keyword.kwlist}
    s, t = parsed(reference), parsed(answer)
    share = lambda want, have: sum((want & have).values()) / sum(want.values()) if want else 1.0
    tree = 0.0 if s is None or t is None else share(_subtrees(s), _subtrees(t))
    flow = 0.0 if s is None or t is None else share(_flows(s), _flows(t))
    return {"ngram": bleu(x, y), "weighted": bleu(x, y, weights=weights), "tree": tree, "flow": flow}


def codebleu(reference: str, answer: str) -> float:
    """The mean of ``codebleu_parts``."""
    return sum(codebleu_parts(reference, answer).values()) / 4


# --- diffs ------------------------------------------------------------------


def unified_diff(before: str, after: str, context: int = 0) -> str:
    """Hunks of a unified diff without file headers."""
    lines = list(difflib.unified_diff(before.splitlines(), after.splitlines(), lineterm="", n=context))
    return "\n".join(lines[2:])


#: A line and its end, cut as ``str.splitlines`` cuts.
_LINE = re.compile("([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|(?<=.)\\Z)", re.DOTALL)
_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@")


def diff_changes(diff: str) -> Iterator[tuple[int, int, int | None, str | None, str | None]]:
    """(hunk, old_start, place, op, line) of each change, one after another; a hunk without
    changes is one row with nulls.  op is ' ', '-' or '+'.

    Headers stand only before the first hunk, so a deleted line that begins with '--'
    isn't mistaken for one; a line without a mark is context.
    """
    hunk, start, place = -1, 0, 0
    for found in _LINE.finditer(diff):
        line = found[1] or ""
        if m := _HUNK.match(line):
            if hunk >= 0 and not place:
                yield hunk, start, None, None, None
            hunk, start, place = hunk + 1, int(m[1]), 0
        elif hunk >= 0 and (line[:1] in ("+", "-", " ") and line or line.strip() and not line.startswith("\\")):
            marked = line[:1] in ("+", "-", " ")
            yield hunk, start, place, line[0] if marked else " ", line[1:] if marked else line
            place += 1
    if hunk >= 0 and not place:
        yield hunk, start, None, None, None


def parse_diff(diff: str) -> list[dict]:
    """Hunks: old_start and changes (op, line); see ``diff_changes``."""
    out: list[dict] = []
    for hunk, start, place, op, line in diff_changes(diff):
        if hunk == len(out):
            out.append({"old_start": start, "changes": []})
        if place is not None:
            out[-1]["changes"].append({"op": op, "line": line})
    return out


class DiffChanges:
    """Table function: the rows of ``diff_changes``, none of a null diff; no array of a whole diff is made."""

    def eval(self, diff: str):
        if diff is not None:
            yield from diff_changes(diff)


def with_diff_changes(df: DataFrame, diff: str) -> DataFrame:
    """df with a row for each change of a diff (hunk, old_start, place, op, line); rows without hunks go."""
    ship(df.sparkSession)
    function = F.udtf(DiffChanges, returnType="hunk int, old_start int, place int, op string, line string")
    return df.lateralJoin(function(F.col(diff).outer()))


def _locate(lines: list[str], wanted: str, hint: int) -> int | None:
    """Nearest line equal up to surrounding blanks, else the best fuzzy match near the hint."""
    bare = wanted.strip()
    same = [i for i, line in enumerate(lines) if line.strip() == bare]
    if same:
        return min(same, key=lambda i: (abs(i - hint), i))
    rated = [(difflib.SequenceMatcher(None, line.strip(), bare).ratio(), i) for i, line in enumerate(lines)]
    rated = [(r - NEAR * abs(i - hint), i) for r, i in rated if r >= FUZZY]
    return max(rated, key=lambda x: (x[0], -x[1]))[1] if rated else None


def apply_diff(source: str, diff: str) -> str:
    """Source with the hunks applied, even where their line numbers are off.

    Each deletion goes to the nearest matching line; additions follow the place of the
    last deletion or context line, else the hunk's own, clamped to the text.
    """
    lines, shift = source.splitlines(), 0
    for hunk in parse_diff(diff):
        deletes = any(c["op"] == "-" for c in hunk["changes"])
        at = max(0, min(len(lines), hunk["old_start"] + shift - (1 if deletes else 0)))
        for change in hunk["changes"]:
            if change["op"] == "+":
                lines.insert(min(at, len(lines)), change["line"])
                at, shift = at + 1, shift + 1
                continue
            place = _locate(lines, change["line"], at)
            if change["op"] == " ":
                at = at if place is None else place + 1
            elif place is not None:
                del lines[place]
                at, shift = place, shift - 1
    return "\n".join(lines)


def reconstruct(answers: list[str]) -> str | None:
    """Last full python block of a conversation with all later diffs applied in order."""
    code = None
    for text in answers:
        for kind, block in re.findall(r"(?s)```(python|diff)\s*\n(.*?)```", text or ""):
            if kind == "python":
                code = block.strip("\n")
            elif code is not None:
                code = apply_diff(code, block)
    return code


def representation(before: str | None, after: str, strategy: str = "one_block", grade_changed: bool = False) -> str:
    """'full' or 'diff': how a submission is shown after the one before.

    one_block: one hunk and under half of the lines changed; content_diff: token similarity
    above a half; progression: the grade hasn't changed.  The first submission, and one
    after an empty one, is full.
    """
    if not before:
        return "full"
    diff = unified_diff(before, after)
    if strategy not in ("one_block", "content_diff", "progression"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "content_diff":
        small = token_similarity(before, after) > 0.5
    elif strategy == "progression":
        small = not grade_changed
    else:
        old = before.strip().split("\n") if before.strip() else []
        changed = sum(line[:1] in ("+", "-") for line in diff.split("\n"))
        small = len(parse_diff(diff)) == 1 and bool(old) and changed / len(old) < 0.5
    return "diff" if small else "full"


# --- columns ----------------------------------------------------------------

_KINDS = {
    "code_hash": (code_hash, "string"), "compiles": (compiles, "boolean"), "reprinted": (reprinted, "string"),
    "tokens_with_comments": (tokens_with_comments, "array<string>"), "tokens_with_indents": (tokens_with_indents, "array<string>"),
    "token_distance": (token_distance, "double"), "token_edits": (token_edits, "double"), "token_similarity": (token_similarity, "double"),
    "tree_edits": (tree_edits, "double"), "tree_size": (tree_size, "double"), "tree_distance": (tree_distance, "double"),
    "bleu_distance": (bleu_distance, "double"), "rouge_distance": (rouge_distance, "double"), "rouge2_distance": (rouge2_distance, "double"),
    "rouge_l_distance": (rouge_l_distance, "double"), "rouge_lsum_distance": (rouge_lsum_distance, "double"),
    "token_edits_over_source": (token_edits_over_source, "double"), "tree_edits_over_source": (tree_edits_over_source, "double"), "codebleu": (codebleu, "double"), "codebleu_parts": (codebleu_parts, "struct<ngram:double,weighted:double,tree:double,flow:double>"),
    "unified_diff": (unified_diff, "string"), "apply_diff": (apply_diff, "string"),
    "parse_diff": (parse_diff, "array<struct<old_start:int,changes:array<struct<op:string,line:string>>>>"),
    "reconstruct": (lambda xs: reconstruct(list(xs)), "string"),
    "representation": (representation, "string"), "closest": (lambda w, ks: closest(w, list(ks)), "string"),
}


_ONE = {"code_hash", "compiles", "reprinted", "tokens_with_comments", "tokens_with_indents", "tree_size", "parse_diff", "reconstruct"}


def shown_as(before, after, strategy: str = "one_block", grade_changed=None):
    """Column of ``representation``; without ``grade_changed`` no grade has changed."""
    changed = F.lit(False) if grade_changed is None else F.coalesce(grade_changed, F.lit(False))
    return udf("representation")(before, after, F.lit(strategy), changed)


class _Known:
    """A function that keeps its results in a worker's task: programs recur, and a repeated one costs
    a look.  It forgets them all once they hold ``HELD`` characters, so they take bounded memory."""

    def __init__(self, function) -> None:
        self.function, self.found, self.size = function, {}, 0

    def __call__(self, *row):
        try:
            return self.found[row]
        except KeyError:
            pass
        except TypeError:  # a list can't be looked up
            return self.function(*row)
        made = self.function(*row)
        size = 256 + sum(len(x) for x in (*row, made) if isinstance(x, str)) + (64 * len(made) if isinstance(made, list | dict) else 0)
        if self.size + size > HELD:
            self.found, self.size = {}, 0
        if size <= HELD:
            self.found[row], self.size = made, self.size + size
        return made


def udf(name: str):
    """A pandas UDF of one of the functions above, for the active session."""
    if session := SparkSession.getActiveSession():
        ship(session)
    function, kind = _KINDS[name]
    known = _Known(function)

    if name == "representation":  # before, after, strategy, whether the grade changed
        def represented(before: pd.Series, after: pd.Series, strategy: pd.Series, changed: pd.Series) -> pd.Series:
            rows = zip(before, after, strategy, changed)
            return pd.Series([None if a is None or s is None else known(b, a, s, bool(c)) for b, a, s, c in rows], dtype=object)

        return F.pandas_udf(represented, kind)

    def one(*row):
        return None if any(x is None for x in row) else known(*row)

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns)], dtype=object)

    if kind.startswith("struct"):
        names = [f.split(":")[0] for f in kind[7:-1].split(",")]

        def table(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(*row) or dict.fromkeys(names) for row in zip(a, b)], columns=names, dtype=float)

        return F.pandas_udf(table, kind)

    def unary(a: pd.Series) -> pd.Series:
        return batch(a)

    def binary(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    return F.pandas_udf(unary if name in _ONE else binary, kind)
