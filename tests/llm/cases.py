"""Small tables that every operator must handle."""

LONG = "stream of words " * 4000
EDGE = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "   \n\t ", "en", None),
    (4, "Hello wörld, hello again\nHello wörld, hello again", "en", "a"),
    (4, "Hello wörld, hello again\nHello wörld, hello again", "en", "a"),
    (5, LONG, "fr", "b"),
    (6, "x" * 9000, "fr", "b"),
    (None, "no id here", "de", "c"),
    (7, "日本語 text Привет мир", "xx", "c"),
    (8, "Hello wörld, hello again\nHello wörld, hello again", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names of results, which the inputs may have too.
CLASHES = ["fingerprint", "spans", "part", "copy", "hash", "bucket", "score", "kept", "h", "n_words", "slot", "shard", "component_id", "count", "key", "block", "ids", "id", "_id", "number", "live", "place", "own", "middle", "below", "above", "__salt", "__h", "label", "root", "fp", "keys", "bins", "digest", "copies", "tokens", "judged", "repositories", "owners", "value"]


def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


def empty(spark):
    return edge(spark).limit(0)
