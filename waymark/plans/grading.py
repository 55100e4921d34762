"""Grading of programs in separate, resource-limited process trees.

Nothing is executed unless ``grade_programs`` is called.  Each run has a supervisor.  The
program is its child in a PID namespace with a /proc of its own, where the system allows
that: it sees no process of other runs, and all that it has started ends with it, whatever
session or parent they took.  Elsewhere the supervisor is the subreaper of its descendants; it stops
all of them, kills them and waits until none is left.  Only then does the run count as over.  Output,
errors and score go through pipes that the supervisor's own process tree alone holds, never
through files; a score's pipe exists for the test only, which runs afterwards in a tree of
its own and can't be traced by others of its user.  So nothing that a program does or leaves behind reaches its own score or that of
another.  A test that executes the program's text itself gives that protection up.  Limits hold
on time, memory, written bytes and printed bytes.  Where there are no namespaces, a
program may kill its supervisor: its own run fails then.  These limits are no full sandbox (the network and
readable files stay in reach): run untrusted programs on workers that can be thrown away.
"""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import compiles
from ..workers import ship

SECONDS, MEGABYTES, THREADS = 5, 512, 4
#: Bytes that a program may print; one that prints more fails.
OUTPUT_BYTES = 1 << 20

#: The supervisor: a child with limits runs the job; afterwards no descendant is left.
_SUPERVISOR = """
import builtins, ctypes, json, os, random, resource, signal, sys, time
job = json.load(sys.stdin)
said, score = job["said"], job["score"]
libc = ctypes.CDLL(None, use_errno=True)
DEATHSIG, DUMPABLE, SUBREAPER = 1, 4, 36  # of prctl

stop = []
signal.signal(signal.SIGTERM, lambda *a: stop.append(True))

def program():
    signal.signal(signal.SIGTERM, signal.SIG_DFL)
    os.close(said)
    if score is None or not job["test"]:
        os.closerange(3, 256)
    for kind, most in ((resource.RLIMIT_CPU, job["seconds"]), (resource.RLIMIT_AS, job["bytes"]), (resource.RLIMIT_FSIZE, job["written"]), (resource.RLIMIT_CORE, 0)):
        resource.setrlimit(kind, (most, most))
    random.seed(42)
    if job["test"]:
        libc.prctl(DUMPABLE, 0, 0, 0, 0)
        space = {"__name__": "__main__", "program_output": job["output"], "program_code": job["code"]}
        exec(compile(job["test"], "test", "exec"), space)
        os.write(score, json.dumps(float(space.get("score", 0))).encode())
    else:
        given = iter(job["inputs"])
        builtins.input = lambda *a: next(given, "")
        exec(compile(job["code"], "program", "exec"), {"__name__": "__main__"})

def run():
    # leaves through the interpreter's own end, so that output is flushed and errors are printed
    pid = os.fork()
    if not pid:
        program()
        sys.exit()
    return pid

def children():
    found = []
    for name in os.listdir("/proc"):
        if name.isdigit():
            try:
                with open(f"/proc/{name}/stat") as stat:
                    found.append((int(stat.read().rpartition(")")[2].split()[1]), int(name)))
            except OSError:
                pass
    below, more = {os.getpid()}, True
    while more:
        more = {child for parent, child in found if parent in below} - below
        below |= more
    return below - {os.getpid()}

def clear():
    # stopped first, so that none can start another while the others are killed
    while True:
        known = set()
        while (now := children()) - known:
            for pid in now - known:
                try:
                    os.kill(pid, signal.SIGSTOP)
                except OSError:
                    pass
            known |= now
        for pid in known:
            try:
                os.kill(pid, signal.SIGKILL)
            except OSError:
                pass
        try:
            while True:
                os.waitpid(-1, 0)
        except ChildProcessError:
            if not children():
                return

def wait(pid, until):
    while time.monotonic() < until and not stop:
        done, status = os.waitpid(-1, os.WNOHANG)
        if done == pid:
            return status
        if not done:
            time.sleep(0.002)
    return None

libc.prctl(DUMPABLE, 0, 0, 0, 0)
user, group = os.getuid(), os.getgid()
apart = False
for flags in (os.CLONE_NEWPID | os.CLONE_NEWNS, os.CLONE_NEWUSER | os.CLONE_NEWPID | os.CLONE_NEWNS) if job["apart"] else ():
    try:
        libc.prctl(DUMPABLE, 1, 0, 0, 0)
        os.unshare(flags)
        if flags & os.CLONE_NEWUSER:
            for name, text in (("setgroups", "deny"), ("uid_map", f"{user} {user} 1"), ("gid_map", f"{group} {group} 1")):
                with open(f"/proc/self/{name}", "w") as file:
                    file.write(text)
        apart = True
        break
    except OSError:
        pass
until = time.monotonic() + job["seconds"] + 0.5
if apart:
    first = os.fork()
    if not first:  # the namespace's first process: when it ends, all others in there do
        libc.prctl(DEATHSIG, signal.SIGKILL, 0, 0, 0)
        libc.mount(b"none", b"/", None, 0x4000 | 0x40000, None)
        libc.mount(b"proc", b"/proc", b"proc", 0, None)
        inner = run()
        status = wait(inner, until + 60)
        os.write(said, json.dumps(status).encode())
        os._exit(0)
    if wait(first, until) is None:
        os.kill(first, signal.SIGKILL)
        os.waitpid(first, 0)
        os.write(said, b"null")
else:
    libc.prctl(SUBREAPER, 1, 0, 0, 0)
    status = wait(run(), until)
    clear()
    os.write(said, json.dumps(status).encode())
os._exit(0)
"""


def _run(job: dict, seconds: int, megabytes: int, apart: bool = True) -> tuple[str, str | None, float | None]:
    """(output, error, score) of one process tree."""
    said, tell = os.pipe()
    read, write = os.pipe()
    limits = {"said": tell, "score": write, "seconds": seconds, "bytes": megabytes << 20, "written": OUTPUT_BYTES, "apart": apart}
    with tempfile.TemporaryDirectory() as work:
        process = subprocess.Popen([sys.executable, "-I", "-c", _SUPERVISOR], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=work, env={"PYTHONHASHSEED": "0"}, pass_fds=(tell, write), start_new_session=True)
        os.close(tell)
        os.close(write)
        with suppress(BrokenPipeError):
            process.stdin.write(json.dumps(job | limits).encode())
            process.stdin.close()
        pipes = {process.stdout.fileno(): bytearray(), process.stderr.fileno(): bytearray(), said: bytearray(), read: bytearray()}
        late, until = False, time.monotonic() + seconds + 10
        with selectors.DefaultSelector() as waiting:
            for fd in pipes:
                waiting.register(fd, selectors.EVENT_READ)
            while waiting.get_map():
                late = late or time.monotonic() > until or len(pipes[process.stdout.fileno()]) > OUTPUT_BYTES
                if late:
                    break
                for key, _ in waiting.select(0.2):
                    got = os.read(key.fd, 1 << 16)
                    if not got:
                        waiting.unregister(key.fd)
                    elif len(pipes[key.fd]) <= OUTPUT_BYTES:
                        pipes[key.fd] += got
        if late:  # it ends its tree first
            process.terminate()
        process.wait()
        output, errors, status, score = (bytes(pipes[fd]) for fd in (process.stdout.fileno(), process.stderr.fileno(), said, read))
        for fd in (said, read):
            os.close(fd)
        process.stdout.close()
        process.stderr.close()
    text = output.decode("utf-8", "replace")
    if late and len(output) > OUTPUT_BYTES:
        return text[:OUTPUT_BYTES], "OutputTooLong", None
    code = json.loads(status) if status and not late else None
    if code is None:
        return text, "TimeoutExpired" if late or status else "Killed", None
    code, lines = os.waitstatus_to_exitcode(code), errors.decode("utf-8", "replace").strip()
    error = f"signal {-code}" if code < 0 else lines.splitlines()[-1] if code and lines.startswith("Traceback") else None
    return text, error, json.loads(score) if score and error is None else None


def run_program(code: str, test: str | None = None, inputs: list[str] | None = None, seconds: int = SECONDS, megabytes: int = MEGABYTES, apart: bool = True) -> dict:
    """output, error and score of one program; the score is what its test leaves in ``score``.

    ``apart`` asks for a PID namespace; without, or where there is none, the supervisor reaps.
    """
    if not compiles(code):
        return {"output": "", "error": "SyntaxError", "score": None}
    output, error, _ = _run({"code": code, "inputs": inputs or [], "test": None}, seconds, megabytes, apart)
    score = None
    if error is None and test:
        _, error, score = _run({"test": test, "output": output, "code": code}, seconds, megabytes, apart)
    return {"output": output, "error": error, "score": score}


def grade_programs(rows: DataFrame, keys: list[str], code: str = "code", test: str = "testcase", most: float = 100.0, threads: int = THREADS) -> DataFrame:
    """keys with grade (score / most * 100; 0 for any failure), error and output.

    Each row starts a process or two, ``threads`` rows of a task at a time; rows keep their
    order.  The result isn't deterministic by nature: write it out before it is used twice.
    """
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", new_grade double, error string, output string"

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                done = list(pool.map(lambda job: run_program(job[0] or "", job[1]), zip(b[code], b[test])))
                out = b[keys].copy()
                out["new_grade"] = [float(d["score"]) / most * 100 if d["error"] is None and d["score"] is not None else 0.0 for d in done]
                out["error"] = [d["error"] for d in done]
                out["output"] = [d["output"] for d in done]
                yield out

    return rows.select(*dict.fromkeys([*keys, code, test])).mapInPandas(grade, schema)


def grader(tests: DataFrame, on: Sequence[str], test: str = "testcase", threads: int = THREADS) -> Callable[[DataFrame], DataFrame]:
    """A ``grade`` for ``rollout``: runs each row's code against the test of its ``on`` columns."""

    def grade(rows: DataFrame) -> DataFrame:
        task = [c for c in rows.columns if c not in ("code", test)]
        known = rows.join(tests.select(*on, F.col(test)), list(on), "left")
        done = grade_programs(known.where(F.col("code").isNotNull()), task, "code", test, threads=threads)
        said = F.concat(F.lit("Unit Test Returned: "), F.col("new_grade").cast("string"), F.coalesce(F.concat(F.lit("\n"), F.col("error")), F.lit("")), F.lit("\n"), F.col("output"))
        return done.select(*task, F.col("new_grade").alias("grade"), said.alias("feedback"))

    return grade
