"""Canonical keys of actions: what shares one and what doesn't."""

import pytest

from cachelake.operators import commands as cm

LABELS = ("app/one/__lib__/0123456789abcdef/", "other/__lib__/fedcba9876543210/")


class World:
    """Actions by name, each over an input tree of its own."""

    def __init__(self):
        self.args, self.env, self.outputs, self.files, self.contents, self.actions = [], [], [], [], {}, []

    def add(self, action, label, args=(), env=(), outputs=("x",), argsfiles=None, sources=None):
        root = f"root-{action}"
        self.actions.append((action, root))
        self.args += [(action, i, a) for i, a in enumerate([f"{label}lib.rs", *args])]
        self.env += [(action, n, v) for n, v in env]
        self.outputs += [(action, i, label + o) for i, o in enumerate(outputs)]
        for path, text in (argsfiles or {}).items():
            self.contents[f"c{hash(text)}"] = text
            self.files.append((root, path, f"c{hash(text)}"))
        self.files += [(root, p, h) for p, h in (sources or {"src/a.rs": "1"}).items()]
        return self

    def keys(self, spark):
        make = spark.createDataFrame
        got, failed = cm.canonical_keys(
            make(self.actions, "action string, root string"), make(self.args, "action string, pos int, token string"), make(self.env, "action string, name string, value string"),
            make(self.outputs, "action string, pos int, path string"), make(self.files, "root string, path string, hash string"), make(list(self.contents.items()), "hash string, content string"),
        )
        return {r.action: r.key for r in got.collect()}, sorted((r.action, r.path) for r in failed.collect())


def test_twins_share_a_key_and_others_do_not(spark):
    files = lambda label: {"args/a": f"-Cmetadata={label}\n@args/b\n", "args/b": f"--path-env=OUT={label}out\r\n-O"}
    w = World()
    for name, label in zip(("a", "b"), LABELS, strict=True):
        w.add(name, label, ["--buck-target=" + label, "@args/a"], [("T", label)], argsfiles=files(label))
    same = {"argsfiles": files(LABELS[0])}
    base = ["--buck-target=x", "@args/a"]
    w.add("other source", LABELS[0], base, [("T", LABELS[0])], sources={"src/a.rs": "2"}, **same)
    w.add("more source", LABELS[0], base, [("T", LABELS[0])], sources={"src/a.rs": "1", "src/b.rs": "1"}, **same)
    w.add("other place", LABELS[0], base, [("T", LABELS[0])], sources={"src/b.rs": "1"}, **same)
    w.add("moved", LABELS[0], [*base, f"T={LABELS[0]}"], [], **same)
    w.add("other order", LABELS[0], base[::-1], [("T", LABELS[0])], **same)
    w.add("other file", LABELS[0], base, [("T", LABELS[0])], argsfiles={"args/a": "-Cmetadata=x\n@args/b\n", "args/b": "--path-env=OUT=y\r\n-O2"})
    # A file that only looks like one of arguments is a source.
    w.add("data", LABELS[0], base, [("T", LABELS[0])], argsfiles={**files(LABELS[0]), "args/data.args": "v1"})
    w.add("data2", LABELS[0], base, [("T", LABELS[0])], argsfiles={**files(LABELS[0]), "args/data.args": "v2"})
    keys, failed = w.keys(spark)
    assert not failed and len(keys) == len(w.actions)
    assert keys["a"] == keys["b"]
    assert len(set(keys.values())) == len(keys) - 1


def test_files_that_cannot_be_had(spark):
    w = World().add("gone", "l/", ["@none"]).add("deep", "l/", ["@f"], argsfiles={"f": "@lost\n -x \n@ g"}).add("third", "l/", ["@f"], argsfiles={"f": "@g", "g": "@h"}).add("no content", "l/", ["@src/a.rs"])
    w.contents["unused"] = ""
    keys, failed = w.keys(spark)
    assert set(keys) == {"third"}  # what the second round names isn't followed
    assert failed == [("deep", " g"), ("deep", "lost"), ("gone", "none"), ("no content", "src/a.rs")]


@pytest.mark.parametrize("text,want", [("-Cmetadata=1\r\n@x", "-Cmetadata=__CKEY__\r\n@x\n"), ("", "\n"), ("a\n", "a\n\n")])
def test_argument_files_line_by_line(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cm.normalize_argsfile(df["t"])).first()[0] == want
