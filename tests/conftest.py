import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phasefold.session import local_session  # noqa: E402

BASE = ["x", "y", "z", "vx", "vy", "vz"]


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def cloud():
    """1500 rows: a dense core, 200 rows at one place, a sparse halo."""
    rng = np.random.default_rng(3)
    pos = rng.normal(size=(1500, 3)) * 20.0
    pos[:500] *= 0.02
    pos[500:700] = pos[500]
    vel = rng.normal(size=(1500, 3)) * 80.0
    frame = pd.DataFrame(np.hstack([pos, vel]), columns=BASE)
    frame["particle_id"] = (np.arange(1500) * 37) % 10007
    frame["is_stream"] = (rng.random(1500) < 0.3).astype(int)
    frame["file_id"] = np.arange(1500) % 3
    return frame
