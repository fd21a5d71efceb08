"""Fixtures of the text operators' tests; imported by name, so that the folder above keeps its conftest."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""
    def make(rows, extra=""):
        return spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string" + extra)
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
