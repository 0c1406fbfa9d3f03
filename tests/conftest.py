import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanflow.session import checkpoint_dir, get_spark
    s = get_spark("*", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def java_tokens(spark):
    """Token table of lexed Java snippets: ``(spark, snippets) -> DataFrame``."""
    from spanflow.operators.tokens import token_table

    def make(snippets):
        docs = spark.createDataFrame(list(enumerate(snippets)), "doc_id long, text string")
        return token_table(docs, lang="java", with_label=True)
    return make
