import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relinfer.config import ModelConfig  # noqa: E402
from relinfer.session import local_session  # noqa: E402
from relinfer.sources.weights import formula_model  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

# The smallest model with all the structure: two layers, grouped heads.
SMALL = ModelConfig(
    hidden=12, n_layers=2, head_dim=8, n_heads=6, n_kv_heads=2, ffn_dim=16, vocab_size=32
)


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def model(spark):
    return formula_model(spark, SMALL)


@pytest.fixture(scope="session")
def prompts(spark):
    """Three prompts of 5, 3 and 7 tokens, none of them a stop token."""
    rows = [
        (s, p, (7 * s + 3 * p + p * p) % 29 + 3)
        for s, n in ((1, 5), (2, 3), (3, 7)) for p in range(n)
    ]
    return spark.createDataFrame(rows, "seq_id bigint, pos bigint, token int")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
