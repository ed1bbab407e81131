import pytest
from pyspark.sql import functions as F

from cookwright.operators.quantities import parse_amounts, quantities

LINES = {
    "3 lbs / 1361 g apricots, peeled": [(3, 1, "lb")], "2 (8 oz.) cans rye bread": [(16, 1, "oz")], "20½ ounce": [(41, 2, "oz")], "6 ¼ generous tablespoon thyme": [(25, 4, "tbsp")],
    "275–300 gr de ruibarbo": [(275, 1, "g")], "5-2/3 heaped cups cream": [(17, 3, "cup")], "4 tins (4 × 60 gm) rice": [(240, 1, "g")], "3 x 90 milliliters cans": [(270, 1, "ml")],
    "small apricots: 4 (755 g) packs": [(3020, 1, "g")], "2 pound 5 ounces of mackerel": [(2, 1, "lb"), (5, 1, "oz")], "3 Ã‚Â¼ quarts": [(13, 4, "quart")], "3 1/2 kryddmÕtt": [(7, 2, "krm")],
    "15½ fl. oz. barley": [(31, 2, "fl oz")], "a cup of milk": [(1, 1, "cup")], "cuatro cucharaditas": [(4, 1, "tsp")], "two 14-ounce cans": [(28, 1, "oz")], "12 lemons": [], "see page 404 of the book": [],
    "eggs, cut into 2 cm cubes": [], "": [], "1/0 g": [],
}
YIELDS = {"Makes 4 pieces": [(4, 1, "count")], "4–6": [(4, 1, "count")], "['4']": [(4, 1, "count")], "half a dozen": [(12, 2, "count")], "1 1/2 dozen rolls": [(36, 2, "count")], "Makes about 500 g": [(500, 1, "g")], "a crowd": [], "4 doz.": [(48, 1, "count")], "one 20 cm pan": [(1, 1, "count")]}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    assert parse_amounts(line) == LINES[line]


@pytest.mark.parametrize("text", YIELDS)
def test_yields(text):
    assert parse_amounts(text, True) == YIELDS[text]


FACTORS = [("g", "g", 1.0), ("kg", "g", 1000.0), ("oz", "g", 28.35), ("lb", "g", 453.6), ("tsp", "ml", 5.0), ("cup", "ml", 240.0)]


def factors(spark):
    return spark.createDataFrame(FACTORS, "unit string, base_unit string, factor double")


def test_conversion_and_edges(spark):
    rows = [(1, ["1 lb 4 oz salmon", None, "", "1/3 tsp salt", "5 qt water"], "Serves 4", "x"), (2, None, None, "x"), (3, [], "", "x"), (4, ["2 kg " + "flour " * 20_000], "2.5 kg", "x"), (1, ["1 oz"], None, "y")]
    got = quantities(spark.createDataFrame(rows, "row_ix long, ingredients array<string>, recipe_yield string, unit string"), factors(spark)).collect()
    assert sorted(map(tuple, got)) == sorted([(1, "ingredients", 0, "g", 567000), (1, "ingredients", 3, "ml", 1667), (1, "recipe_yield", 0, "count", 4000), (4, "ingredients", 0, "g", 2000000), (4, "recipe_yield", 0, "g", 2500000), (1, "ingredients", 0, "g", 28350)])


def test_half_is_rounded_up_and_empty_table(spark):
    one = spark.createDataFrame([(1, ["0.0005 g"], None)], "row_ix long, ingredients array<string>, recipe_yield string")
    half = spark.createDataFrame([("g", "g", 1.0)], "unit string, base_unit string, factor double")
    assert [r.amount_milli for r in quantities(one, half).collect()] == [1]
    assert quantities(one.limit(0), half).count() == 0
    assert quantities(one, half.where(F.lit(False))).count() == 0


def test_every_part_counts_and_numbers_are_found_at_any_distance(spark):
    lines = ["1 cup 2 tbsp 1 tsp 5 ml milk", "2 " + "large " * 60 + "cups flour", "7" * 17 + " g", "9" * 25 + " g", "2" * 16 + " kg", "1 " + "rounded " * 40 + "tsp salt"]
    more = factors(spark).union(spark.createDataFrame([("tbsp", "ml", 15.0), ("ml", "ml", 1.0)], "unit string, base_unit string, factor double"))
    df = spark.createDataFrame([(1, lines, None)], "row_ix long, ingredients array<string>, recipe_yield string")
    assert {r.line_no: r.amount_milli for r in quantities(df, more).collect()} == {0: 280_000, 1: 480_000, 5: 5_000}
    assert parse_amounts("1 lb " + " ".join(f"{k} oz" for k in range(1, 9)))[1:] == [(k, 1, "oz") for k in range(1, 9)]
