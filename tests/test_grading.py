"""Programs that try to reach a score, and what is left of them."""

import os
import time

import pytest

from waymark.plans.grading import run_program

#: Each leaves a process behind, in its own session, that marks itself by a file it keeps writing.
ESCAPES = {
    "setsid": "import os\nif os.fork(): os._exit(0)\nos.setsid()\n",
    "twice": "import os\nif os.fork(): os._exit(0)\nos.setsid()\nif os.fork(): os._exit(0)\n",
    "kept": "import os\nfor _ in range(4): os.fork()\nos.setsid() if os.getpid() != os.getpgid(0) else None\n",
}
AFTER = "import glob, time\nfor i in range(150):\n    open({mark!r}, 'a').write('x')\n    for f in glob.glob('/tmp/tmp*'):\n        for n in ('result', 'output', 'score'):\n            try: open(f + '/' + n, 'w').write('100.0')\n            except OSError: pass\n    time.sleep(0.02)\n"


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("kind", sorted(ESCAPES))
def test_nothing_outlives_its_run(tmp_path, kind, apart):
    mark = tmp_path / "mark"
    code = ESCAPES[kind] + AFTER.format(mark=str(mark))
    assert run_program(code, "import time\ntime.sleep(0.2)\nscore = 0", seconds=1, apart=apart)["score"] in (0, None)
    size = mark.stat().st_size if mark.exists() else 0
    assert run_program("print('yes')", "score = 7 if program_output == 'yes\\n' else 1", apart=apart)["score"] == 7
    time.sleep(0.1)
    assert (mark.stat().st_size if mark.exists() else 0) == size


@pytest.mark.parametrize("apart", [True, False])
def test_no_descriptor_of_the_score(apart):
    """A program finds no pipe but its three own, and no process but its own tree's."""
    look = "import os\nfor fd in range(3, 64):\n    try:\n        os.write(fd, b'100.0')\n        print('wrote', fd)\n    except OSError:\n        pass\n"
    out = run_program(look, "score = 0", apart=apart)
    assert out["output"] == "" and out["score"] == 0
    if apart:
        found = run_program("import os\nprint(sorted(int(x) for x in os.listdir('/proc') if x.isdigit()))")["output"]
        assert found in ("[1, 2]\n", found if len(eval(found)) > 50 else "")  # no namespaces here: all are seen


def test_a_killed_supervisor_fails_its_own_run():
    out = run_program("import os, signal\nos.kill(os.getppid(), signal.SIGKILL)\nimport time\ntime.sleep(3)", "score = 100", apart=False, seconds=1)
    assert out["score"] is None and out["error"]
    assert run_program("x = 1", "score = 5")["score"] == 5


def test_limits():
    assert run_program("x = bytearray(1 << 30)")["error"] == "MemoryError"
    began = time.monotonic()
    for apart in (True, False):
        assert run_program("import time\ntime.sleep(60)", seconds=1, apart=apart)["error"] == "TimeoutExpired"
        assert run_program("while True: print('x' * 10_000)", apart=apart)["error"] == "OutputTooLong"
    assert time.monotonic() - began < 10
    assert run_program("print(open('a', 'w').write('b')); import os; print(os.listdir('.'))")["output"] == "1\n['a']\n"
    assert not [x for x in os.listdir("/proc/self/fd") if int(x) > 200]
