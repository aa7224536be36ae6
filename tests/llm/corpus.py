"""A small table with the hard cases, and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéioß") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def text(n):
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(n))

    made = [text(rng.randint(1, 12)) for _ in range(60)]
    made += [made[0].upper(), made[0], made[1] + " x", " ".join(made[2].split()), text(900), "", " \n\t ", None, None, "a", "A b", "   É́", "one two\x0bthree\x0cfour", "####$$$ |<>|", "z" * 5000]
    passage = "\n".join(text(1) for _ in range(4))
    made += [f"{text(2)}\n{passage}\n{text(1)}" for _ in range(3)]
    made += ["near " + " ".join(vocabulary[:80]) + f" {w}" for w in ("alpha", "alpha", "beta", "gamma")]
    made += ["same line\nsame line\nsame line\nsame line\nsame line"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", None]), len(t or "")) for i, t in enumerate(made)]
    return out + [out[5], (None, made[7], None, None, None), (None, "nobody's text", "en", "s2", 13), (200, made[0], "en", "s1", 1)]


def clashing(spark, made):
    """The rows with further columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made, SCHEMA)
    for name in ("_key", "_sha", "_size", "_kept", "_bucket", "fp", "h", "kept", "_dropped", "_lang", "_offset", "_source", "c0", "lines"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df
