"""Statements from definition to drop."""

import pytest

from polymera.session import Engine
from polymera.statements import Statements


def test_statements(spark, tmp_path):
    s = Statements(Engine(spark))
    rows = lambda text: sorted(map(tuple, s.execute(text).collect()), key=repr)
    rows("CREATE COLLECTION users (id TEXT PRIMARY KEY, age INT, v VECTOR(2)) WITH (engine='kv');")
    rows("INSERT INTO users (id, age, v) VALUES ('a', 30, array(1.0, 0.0)), ('b', 40, array(0.0, 1.0))")
    rows("UPSERT INTO users (id, age) VALUES ('b', 41), ('c', 20)")
    rows("INSERT INTO users (id, age) VALUES ('c', 99), ('d', 50) ON CONFLICT DO NOTHING")
    rows("UPDATE users SET age = age + 1 WHERE id = 'd'")
    rows("DELETE FROM users WHERE age < 25")
    assert rows("SELECT id, age FROM users") == [("a", 30), ("b", 41), ("d", 51)]
    assert rows("DESCRIBE users")[1] == ("id", "string", "true")
    assert ("users", "kv") in rows("SHOW COLLECTIONS")
    assert [r["id"] for r in s.execute("SEARCH users USING VECTOR(v, ARRAY[1.0, 0.1], 1)").collect()] == ["a"]
    path = str(tmp_path / "u.ndjson")
    rows(f"COPY (SELECT id, age FROM users) TO '{path}'")
    rows("CREATE COLLECTION copies (id TEXT, age INT)")
    rows(f"COPY copies FROM '{path}'")
    assert len(rows("SELECT * FROM copies")) == 3
    rows("CREATE MATERIALIZED VIEW old AS SELECT id FROM copies WHERE age > 40")
    rows("INSERT INTO copies VALUES ('z', 90)")
    rows("REFRESH MATERIALIZED VIEW old")
    assert rows("SELECT * FROM old") == [("b",), ("d",), ("z",)] and rows("SHOW MATERIALIZED VIEWS") == [("old",)]
    rows("CREATE COLLECTION follows (_from TEXT, _to TEXT, _type TEXT)")
    rows("INSERT INTO follows VALUES ('a', 'b', 'knows'), ('b', 'd', 'knows')")
    assert rows("GRAPH ALGO WCC ON follows") == [("a", "a"), ("b", "a"), ("d", "a")]
    assert rows("GRAPH TRAVERSE follows FROM 'a' DEPTH 1") == [("a", 0), ("b", 1)]
    assert rows("MATCH (x)-[:knows*1..2]->(y) ON users, follows WHERE x = 'a' RETURN y ORDER BY y LIMIT 5") == [("b",), ("d",)]
    rows("CREATE SEQUENCE q START WITH 5")
    assert rows("SELECT nextval('q')") == [(5,)] and rows("SHOW SEQUENCES") == [("q", "5")]
    rows("TRUNCATE users")
    assert rows("SELECT count(*) FROM users") == [(0,)]
    rows("DROP COLLECTION users")
    with pytest.raises(ValueError):
        rows("DROP COLLECTION users")
