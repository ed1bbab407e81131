"""Word tables of the text functions. Results depend on exactly these words."""

UNITS = """cup cups tablespoon tablespoons tbsp teaspoon teaspoons tsp ounce ounces oz pound pounds lb lbs gram grams kg ml
liter liters pinch dash package packages can cans clove cloves slice slices piece pieces small medium large""".split()

PREPARATION = """chopped diced minced sliced peeled crushed ground fresh finely roughly optional divided melted softened cooked
uncooked to taste and or for serving advertisement""".split()

QUERY_STOPWORDS = """a an and adventurous algo any anything cook dish food before different do eaten ever had have haven i know in
new no not make meal med me mig my nagot of please recipe something surprise the tried try unusual want whatever with without och
annorlunda forut har inte jag nytt overraska utan con de diferente haya nuevo probado sin sorprendeme y que quiero""".split()

PREFERENCE_WORDS = "comfort easy fast healthy quick spicy starkt vegetarian vegetarisk picante".split()

PHRASE_ALIASES = [("leche de coco", "coconut milk"), ("kokos mjolk", "coconut milk"), ("kokosmjolk", "coconut milk"), ("chili pepper", "chili")]

# word as it stands after folding: word it counts as
TOKEN_ALIASES = {
    "agg": "egg", "fisk": "fish", "kyckling": "chicken", "lax": "salmon", "lok": "onion", "mjolk": "milk", "notter": "nut",
    "potatis": "potato", "torsk": "cod", "tomat": "tomato", "vitlok": "garlic", "ajo": "garlic", "cebolla": "onion", "huevo": "egg",
    "huevos": "egg", "nueces": "nut", "patata": "potato", "patatas": "potato", "pollo": "chicken", "pescado": "fish", "tomate": "tomato",
    "tomates": "tomato", "eggs": "egg", "onions": "onion", "potatoes": "potato", "tomatoes": "tomato", "chillies": "chili", "chilies": "chili",
}

ADVENTUROUS = [
    "surprise me", "something new", "something different", "something unusual", "something adventurous", "never tried", "have not tried", "haven t tried",
    "have not had", "haven t had", "not had before", "nagot nytt", "nagot annorlunda", "overraska mig", "inte har atit forut", "algo nuevo", "algo diferente",
    "sorprendeme", "no haya probado",
]

BROWSE = ["anything", "anything is fine", "whatever", "food", "i do not know", "i don t know", "i dont know", "no preference", "vad som helst", "jag vet inte", "cualquier cosa", "no se"]

NEGATIONS_LONG = ["without", "excluding", "exclude", "except for", "avoid", "utan", "sin"]
NEGATIONS_SHORT = ["no", "not"]
NEGATION_ENDS = ["with", "med", "con", "but", "men", "pero"]
LIST_WORDS = ["and", "or", "och", "y"]
SEGMENT_WORDS = ["and", "or", "with", "och", "med", "eller", "y", "con"]
PREFERENCE_HEADS = ["quick", "fast", "spicy", "starkt", "picante"]
PREFERENCE_NEGATIONS = ["not", "no", "inte", "without", "avoid", "excluding", "utan", "sin"]
PREFERENCES = [
    ("spicy", ["spicy", "starkt", "picante"]),
    ("quick", ["quick", "fast", "snabbt", "rapido"]),
    ("vegetarian", ["vegetarian", "vegetarisk", "vegetariano", "vegetariana"]),
    ("comfort food", ["comfort food", "comfort", "husmanskost"]),
]
EXCLUDABLE_PREFERENCES = ["spicy", "quick"]

DISTINCTIVE_NOISE = "about amount brand can each free from fully half inch less like note package regular see sheet some such use".split()
PANTRY = ["baking powder", "baking soda", "black pepper", "butter", "egg", "flour", "oil", "olive oil", "pepper", "salt", "sugar", "water", "white sugar"]
SPICY = ["cayenne", "chili", "chili sauce", "hot sauce", "jalapeno", "pepper flake", "sambal", "sriracha"]
NON_DISH = "ale cocktail drink frosting lemonade margarita martini punch sauce seasoning shake smoothie".split()
CATEGORIES = [
    ("dessert", ["brownie", "cake", "cookie", "cupcake", "gelato", "ice cream", "pie"]),
    ("salad", ["salad", "slaw"]),
    ("soup", ["chili", "stew", "soup"]),
    ("pasta", ["lasagna", "noodle", "pasta", "spaghetti"]),
    ("bread", ["bread", "biscuit", "muffin"]),
    ("seafood", ["cod", "crab", "fish", "salmon", "shrimp", "tuna"]),
    ("handheld", ["burger", "sandwich", "taco", "tortilla", "wrap"]),
]

LABEL_SKIP = """all-natural and about advertisement beaten boneless chopped condensed crushed diced divided filtered finely for fresh
frying ground in large lightly medium minus minced optional outer peeled plus roughly slice slices skinless sliced small tender thin to
tough portion removed only recipe still store-bought superfine unsweetened bottled cleaned creamy fat fat-free frozen granulated natural
packed reduced reserving rinsed room spray sweetened temperature thawed thinly top un-iced whipped aisle bought canister coarsely cold
cooked cooking cubed cut dairy drained fine frosted grain halves including into long mix quick sea store shredded the uncooked unfrosted
unsliced""".split()
LABEL_UNITS = """bag bags bottle bottles box boxes can cans clove cloves container containers cup cups cube cubes gram grams g kg jigger
jiggers lb lbs loaf loaves ounce ounces oz package packages piece pieces pound pounds slice slices tablespoon tablespoons tbsp teaspoon
teaspoons tsp""".split()
PANTRY_LABELS = ["all purpose flour", *PANTRY]
PANTRY_WORDS = "baking black butter egg eggs flour oil pepper powder salt soda sugar vegetable water white".split()
CLAUSE_WORDS = "following from garnish instructions near recommended stocked substitute".split()
FEATURE_PENALTIES = "agave bay color frosting garnish honey leaf leaves oil sauce seasoning syrup".split()
DISH_KINDS = [
    ("stir fry", "stir-fry"), ("mac and cheese", "mac and cheese dish"), ("ice cream", "frozen dessert"), ("gelato", "frozen dessert"), ("croquembouche", "pastry"),
    ("truffle", "bite-sized treat"), ("pudding", "dessert"), ("slaw", "salad"), ("rangoon", "filled wonton"), ("dumpling", "dumpling dish"), ("meatloaf", "meatloaf"),
    ("casserole", "casserole"), ("sandwich", "sandwich"), ("pancake", "pancake dish"), ("cupcake", "cupcake"), ("brownie", "brownie"), ("cookie", "cookie"),
    ("biscuit", "biscuit"), ("muffin", "muffin"), ("noodle", "noodle dish"), ("pasta", "pasta dish"), ("spaghetti", "pasta dish"), ("lasagna", "lasagna"),
    ("salad", "salad"), ("curry", "curry"), ("soup", "soup"), ("stew", "stew"), ("chili", "chili"), ("taco", "taco dish"), ("pizza", "pizza"), ("burger", "burger"),
    ("bread", "bread"), ("cake", "cake"), ("pie", "pie"), ("roast", "roast"),
]
STYLES = [
    ("slow cooker", "slow-cooked"), ("slow cooked", "slow-cooked"), ("grilled", "grilled"), ("roasted", "roasted"), ("baked", "baked"), ("creamy", "creamy"),
    ("spicy", "spicy"), ("crispy", "crispy"), ("stuffed", "stuffed"),
]

SOURCE_LABELS = {
    "allrecipes": "Allrecipes", "allrecipes.com": "Allrecipes", "bonappetit": "Bon Appétit", "bonappetit.com": "Bon Appétit",
    "epicurious": "Epicurious", "epicurious.com": "Epicurious", "sample": "Sample data", "development fixture": "Development fixture",
}
SOURCE_ICONS = {f"{x}{end}": f"source-icons/{x}.svg?v=1" for x in ("allrecipes", "bonappetit", "epicurious") for end in ("", ".com")}
AI_CUES = "allergic avoid except excluding gluten minutes minute under utan vegan without".split()
