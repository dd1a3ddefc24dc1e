"""Helpers that run in Python workers must not need the package there."""

import subprocess
import sys

from pyspark import cloudpickle

from rillway.operators.spec_documents import _facts


def run_elsewhere(fn, *args, cwd):
    call = cloudpickle.dumps((fn, args))
    code = "import sys, pickle; f, a = pickle.loads(sys.stdin.buffer.read()); print(f(*a)); assert 'rillway' not in sys.modules"
    path = [p for p in sys.path if p.endswith("site-packages")]
    done = subprocess.run(
        [sys.executable, "-I", "-c", f"import sys; sys.path += {path!r}; {code}"], input=call, capture_output=True, cwd=cwd
    )
    assert done.returncode == 0, done.stderr.decode()
    return done.stdout.decode()


def test_helpers_run_without_the_package(tmp_path):
    assert "'parsed': True" in run_elsewhere(_facts, "<a><step/></a>", cwd=tmp_path)
