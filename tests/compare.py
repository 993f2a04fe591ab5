"""Results as sorted rows of plain values, whatever the order of rows and columns."""


def plain(x):
    return None if x != x else x


def rows(columns: list[str], found) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def same(spark_frame, duck_relation) -> None:
    assert sorted(spark_frame.columns) == sorted(duck_relation.columns)
    assert rows(spark_frame.columns, spark_frame.collect()) == rows(duck_relation.columns, duck_relation.fetchall())
