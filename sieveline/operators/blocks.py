"""Dense pairwise work in blocks: matrix products inside tasks, only reduced rows leave a task."""

import numpy as np

# Rows of one block, which a task holds in memory.
BLOCK_ROWS = 65_536
# Cells of one score matrix held at a time.
CELLS = 4_000_000


def matrix(arrow_lists) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix, without a Python object per row."""
    if hasattr(arrow_lists, "combine_chunks"):
        arrow_lists = arrow_lists.combine_chunks()
    flat = arrow_lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    n = len(arrow_lists)
    if n and flat.size % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, flat.size // n if n else 0)
