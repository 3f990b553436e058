"""Tasks must not need this package on their own path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import numpy as np
from tipoff.functions import network
from tipoff.operators.moments import gram_matrix
from tipoff.plans.fitted_q import score_network
from tipoff.session import local_session
spark = local_session("shipping", cores="1")
frame = spark.createDataFrame([([1.0, 2.0], 1.0, 2.0)], "v array<double>, a double, b double")
assert gram_matrix(frame, "v", "v", (2, 2)).count() == 4
theta = network.initial_parameters(2, 1)
score = score_network(frame, theta, state=["a", "b"]).first().res
assert abs(score - network.forward(theta, np.array([[1.0, 2.0]]))[0]) < 1e-12
print("shipped")
"""


def test_functions_reach_tasks_outside_the_repository(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]
