"""Task functions must not need the package on the executors' import path."""

import os
import subprocess
import sys

from pyspark import cloudpickle

import panelcast
from panelcast.operators.mlp import fit_network
from panelcast.spec import MlpConfig


def test_functions_run_where_the_package_is_absent(tmp_path):
    panelcast.ship_by_value()
    config = MlpConfig(hidden=(3, 2), dropout=(0.0, 0.0), epochs=1, steps=2)

    def task(x, y):
        return len(fit_network(x, y, config, 1)[0])

    (tmp_path / "task").write_bytes(cloudpickle.dumps(task))
    code = (
        "import sys\n"
        "class Absent:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] == 'panelcast':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import pickle, numpy as np\n"
        "print(pickle.load(open('task', 'rb'))(np.ones((5, 2)), np.ones(5)))"
    )
    clean = {k: v for k, v in os.environ.items() if not k.startswith("PYTHON")}
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, check=False)
    assert done.stdout.strip().endswith("3"), done.stderr
