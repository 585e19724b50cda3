"""Models on sufficient statistics, and tree ensembles.

The driver's algebra is on matrices of a few hundred columns, for which one
thread is enough; BLAS threads that were started before the process forks may
never answer again, so there is to be one only.
"""

import ctypes
import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")


def one_thread() -> None:
    """Tell an OpenBLAS that is loaded already, on systems that list loaded libraries."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


import numpy  # noqa: E402, F401  loaded, so that it can be told

one_thread()
