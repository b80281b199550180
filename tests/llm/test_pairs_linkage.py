from sonarium.llm import names


def test_a_component_of_two_is_held_to_the_average_as_well(spark):
    d = spark.createDataFrame([("Margaret Heti Gehulir",), ("Margaret Heti Gehulri",)], "name string")
    entities = lambda at: len({r.entity for r in names.link(d, link_at=at).collect()})
    assert entities(0.3) == 1 and entities(0.99) == 2
