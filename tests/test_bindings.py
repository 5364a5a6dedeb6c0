"""The registered bindings call the library's operators, and those hold beyond the bindings' rows."""

from cuewright import queries
from cuewright.operators import profile
from cuewright.plans.state import State

DATA = "/root/testdata/sf0.001"


def test_upsert_sources_calls_the_state_table(spark, monkeypatch):
    called, merge = [], State.merge
    monkeypatch.setattr(State, "merge", lambda self, table, new: called.append(table) or merge(self, table, new))
    queries.queries()["upsert_sources"](spark, DATA)
    assert called == ["sources"]


def test_merge_of_all_documents(spark):
    docs = queries.documents(spark, DATA).selectExpr("cast(doc_id as string) AS id", "lang AS language", "cast(null as string) AS gone")
    rows = lambda kind: docs.selectExpr("id", "language", "gone AS material_type", "gone AS track", f"'{kind}' AS title", "gone AS source_url", "gone AS creator", "gone AS raw_path", "gone AS cleaned_path", "gone AS imported_at", "gone AS status")
    state = State(spark, "unpublished")
    state.changed["sources"] = rows("old")
    state.merge("sources", rows("new"))
    found = state.read("sources").collect()
    assert len(found) == docs.count() and {r.title for r in found} == {"new"}


def test_vocab_gaps_of_all_signals(spark):
    signals, items = queries.profile_events(spark, DATA), queries.review_items(spark, DATA)
    found = profile.vocab_gaps(signals, items).collect()
    own = {(r.language, r.signal) for r in signals.filter("event_type = 'vocab_gap'").collect()}
    assert {r.language for r in found} == {"en", "ja"} and all((r.language, r.gap) in own for r in found)


def test_vocab_gaps_fall_back_to_words(spark):
    events = spark.createDataFrame([("en", "vocab_gap", "articles", 1.0), ("ja", "other", "x", 1.0)], "language string, event_type string, signal string, strength double")
    items = spark.createDataFrame([(lang, f"{lang}{k}", f"w{k}", kind, "active", 0.1 * k, "2024") for lang in ("en", "ja") for k, kind in enumerate(["vocab", "term", "chunk"])], "language string, id string, content string, item_type string, status string, priority_score double, last_seen_at string").selectExpr("*", "last_seen_at AS first_seen_at")
    found = sorted((r.language, r["rank"], r.gap) for r in profile.vocab_gaps(events, items).collect())
    assert found == [("en", 1, "articles"), ("ja", 1, "w1"), ("ja", 2, "w0")]
