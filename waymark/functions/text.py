"""Scalar text functions as Column expressions: extraction, cleaning, parsing.

Everything here stays inside the JVM.  Patterns use only syntax that Java and RE2
share (no look-around), so they can be checked against other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags and fences of the conversation format.
SUBMISSION = r"(?s)<actual_submission>(.*?)</actual_submission>"
THINK = r"(?s)<think>.*?</think>"
PYTHON_FENCE = r"(?s)```python\s*(.*?)```"
DIFF_FENCE = r"(?s)```diff\s*(.*?)```"
ANY_FENCE = r"(?s)```[a-zA-Z]*\n(.*?)```"
WHOLE_FENCE = r"(?s)```.*?```"
SCORE_LINE = r"(?m)^Unit Test Returned:(.*)$"
LEAVE = ("exit()", "exit", "quit()", "quit")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def clean(text: Column) -> Column:
    """``strip`` with null as the empty text."""
    return strip(F.coalesce(text, F.lit("")))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null (not '') where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match, null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def group_prefix(name: Column, separator: str = "_") -> Column:
    return F.substring_index(name, separator, 1)


def submission(text: Column) -> Column:
    """Stripped content of the submission tag, null without one."""
    return strip(found(text, SUBMISSION))


def without_submission(role: Column, text: Column) -> Column:
    """Assistant turns lose their submission tags; others are unchanged."""
    return F.when(role == "assistant", F.regexp_replace(text, SUBMISSION, "")).otherwise(text)


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, THINK, "")


def first_fence(text: Column) -> Column:
    return found(text, WHOLE_FENCE, 0)


def last_fence(text: Column) -> Column:
    return last_found(text, WHOLE_FENCE, 0)


def fenced_code(text: Column) -> Column:
    """Stripped content of the first fenced block after an optional thought."""
    return strip(found(without_thoughts(text), ANY_FENCE))


def python_code(text: Column) -> Column:
    return strip(found(text, PYTHON_FENCE))


def model_code(text: Column, rebuilt: Column | None = None) -> Column:
    """Code of a generated answer: python fence (also one cut short), else ``rebuilt`` if there
    is a diff fence, else the whole text.

    A closing fence is appended first, so generation may stop before it; an empty fence
    gives null.  ``rebuilt`` is the program that ``functions.code.reconstruct`` makes of the
    conversation; without it an answer that is a diff has no code.
    """
    closed = F.concat(text, F.lit("\n```"))
    fenced = F.nullif(strip(F.regexp_extract(closed, PYTHON_FENCE, 1)), F.lit(""))
    made = F.lit(None).cast("string") if rebuilt is None else F.nullif(rebuilt, F.lit(""))
    return F.when(closed.rlike(PYTHON_FENCE), fenced).when(text.rlike(DIFF_FENCE), made).otherwise(strip(text))


def summative_feedback(text: Column) -> Column:
    """The feedback shown after a submission: all of a grader's output."""
    return text


def student_code(text: Column) -> Column:
    """Submission tag, else python fence, else any fence, else null; empty finds count as none."""
    pick = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(pick(submission(text)), pick(python_code(text)), pick(strip(found(text, ANY_FENCE))))


def score(text: Column) -> Column:
    """Number of the first score line; 0 without a line, null if it isn't a number."""
    raw = found(text, SCORE_LINE)
    return F.when(raw.isNull(), F.when(text.isNotNull(), F.lit(0.0))).otherwise(F.trim(raw).try_cast("double"))


def feedback_grade(text: Column, enabled: Column) -> Column:
    """The score, or null where feedback is disabled."""
    return F.when(enabled, score(text))


def gives_up(code: Column) -> Column:
    """The program without ``#`` comments is only a call to leave."""
    bare = strip(F.regexp_replace(code, r"(?m)#.*$", ""))
    return bare.isin(*LEAVE)


def is_recording(code: Column) -> Column:
    """A row that only records: empty, a call to leave or an ellipsis."""
    bare = clean(code)
    low = F.lower(bare)
    return (bare == "") | F.startswith(low, F.lit("exit()")) | (low == "exit") | (bare == "...")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))


def problem_turn(text: Column) -> Column:
    """Stripped, then without surrounding double quotes."""
    return F.regexp_replace(F.regexp_replace(strip(text), '^"+', ""), '"+$', "")


def masked_feedback(feedback: Column, grade: Column, enabled: Column, right: str = "Correct!", wrong: str = "Not correct yet.") -> Column:
    """Feedback, or a fixed text where feedback is disabled."""
    return F.when(enabled, feedback).when(grade == 100, F.lit(right)).otherwise(F.lit(wrong))


def experiment_format(name: Column) -> Column:
    return F.upper(F.element_at(F.split(name, "_"), -1))


def method_label(steps: Column) -> Column:
    """Training steps joined in upper case; BASE for none."""
    return F.coalesce(F.nullif(F.array_join(F.transform(steps, F.upper), "-"), F.lit("")), F.lit("BASE"))


def md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def fill_template(template: Column, values: dict[str, Column | list[Column]]) -> Column:
    """Replace each ``{name}``; of a list the first, second, ... occurrence by its own value,
    and occurrences beyond the list stay."""
    for name, value in values.items():
        mark = F.lit("{" + name + "}")
        template = _in_turn(template, name, mark, value) if isinstance(value, list) else F.replace(template, mark, value)
    return template


def _in_turn(template: Column, name: str, mark: Column, values: list[Column]) -> Column:
    given = F.array(*values) if values else F.array().cast("array<string>")
    parts = F.split(template, r"\{" + name + r"\}", -1)
    filled = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.coalesce(F.get(given, i - 1), mark), part)))
    return F.array_join(filled, "")


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))


def repeat_each(values: Column, n: int) -> Column:
    """[a, b] -> [a, a, b, b] for n = 2."""
    return F.flatten(F.transform(values, lambda x: F.array_repeat(x, n)))


def tolerant_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Numbers within a tolerance, else equal texts; null equals nothing."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance + 1e-9).otherwise(a == b), F.lit(False))


def matching_lines(a: Column, b: Column) -> Column:
    """Number of positions at which the trimmed lines agree."""
    pairs = F.arrays_zip(F.split(a, "\n").alias("x"), F.split(b, "\n").alias("y"))
    same = F.filter(pairs, lambda p: strip(p["x"]) == strip(p["y"]))
    return F.size(same)


def change_ratio(diff: Column, previous: Column) -> Column:
    """Changed lines of a diff over lines of the stripped text before; 1 if that is empty."""
    changed = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    before = strip(previous)
    return F.when(F.coalesce(before, F.lit("")) == "", F.lit(1.0)).otherwise(F.size(changed) / F.size(F.split(before, "\n")))


def hunk_count(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit(r"(?m)^@@ "))


def char_distance(a: Column, b: Column, how: str = "raw") -> Column:
    """Levenshtein distance: raw, over the longer text or over the first one."""
    d = F.levenshtein(a, b).cast("double")
    over = {"raw": F.lit(1.0), "longer": F.greatest(F.length(a), F.length(b)).cast("double"), "source": F.length(a).cast("double")}[how]
    return F.when(over > 0, d / over).otherwise(F.lit(0.0))


def test_script(testcase: Column, drop: list[str], call: str) -> Column:
    """A test with unwanted lines replaced by nothing and the call appended."""
    for text in drop:
        testcase = F.replace(testcase, F.lit(text), F.lit(""))
    return F.concat(strip(testcase), F.lit("\n" + call))


#: Own wording; formats are those of ``experiment_format``.
SYSTEM_PROMPTS = {
    "code": "You are a learner of programming. Answer with your next program in a python fence.",
    "dual": "You are a learner of programming. Answer with your next program in a python fence, or with a unified diff of your last one in a diff fence.",
}


def system_prompt(kind: str) -> Column:
    """The opening message of a format; an unknown format raises."""
    if kind not in SYSTEM_PROMPTS:
        raise ValueError(f"unknown format {kind!r}; known: {sorted(SYSTEM_PROMPTS)}")
    return F.lit(SYSTEM_PROMPTS[kind])


def leave_messages(grade: Column) -> Column:
    """The two messages by which a learner gives up: the call, and the final grade."""
    made = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    shown = F.concat(F.lit("Unit Test Returned: "), grade.cast("string"))
    return F.array(made("assistant", F.lit("```python\nexit()\n```")), made("user", shown))
