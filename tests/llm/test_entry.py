from __future__ import annotations


def test_all_queries_are_registered():
    """The entry point passes over a subpackage that cannot be imported; this one can."""
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert {"op5_url_filter", "op8_substring_dedup", "op9_ngram_join", "op11_merkle_manifest", "op12_prefix_trie"} <= set(e.oracle_sql()) <= names
