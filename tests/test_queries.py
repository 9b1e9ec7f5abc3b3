"""Every registered query of the core against its SQL twin, or for rows where it has none."""

from __future__ import annotations

import pytest

from leakscope.plans import audit, general, given, stored  # noqa: F401  the last two add to the queries of audit

TWINS = {**audit.oracle_sql(), **general.oracle_sql()}
CORE = {**audit.queries(), **general.queries()}
#: Fit models for long; test_operators covers them on smaller data.
SLOW = {"worstcase_rf", "qmia_tree", "private_svm", "shadow_train", "attribute_bruteforce", "attribute_bounds", "dt_leaf_k", "rf_leaf_k", "shadow_resumed"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(name, spark, sf_dir, twin):
    twin(CORE[name](spark, sf_dir), TWINS[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(TWINS) - SLOW))
def test_rows(name, spark, sf_dir):
    assert CORE[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
