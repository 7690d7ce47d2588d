"""Knobs and fixed vocabularies of the engine.

Word lists below are fixed values: results depend on exactly these entries, and
for aisles and keywords on their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

UNCATEGORIZED = "uncategorized"

# Aisles in walking order.
AISLES = (
    "produce", "meat & seafood", "dairy & eggs", "bakery", "pantry", "canned & jarred", "condiments & sauces",
    "spices & seasonings", "baking", "frozen", "beverages", "other",
)

# Keywords of each aisle, comma-separated. The longest that occurs wins, ties go to the earlier.
KEYWORDS = {
    "produce": "garlic, onion, scallion, green onion, shallot, tomato, lettuce, carrot, potato, bell pepper, jalapeno, "
    "spinach, kale, lemon, lime, apple, banana, avocado, celery, cucumber, mushroom, broccoli, cauliflower, ginger, "
    "parsley, cilantro, basil, zucchini, corn, cabbage, eggplant, sweet potato, lime juice, lemon juice",
    "meat & seafood": "chicken, beef, ground beef, pork, bacon, sausage, turkey, lamb, shrimp, salmon, fish, tuna, steak, "
    "ham, prosciutto",
    "dairy & eggs": "milk, butter, cheese, egg, eggs, cream, heavy cream, yogurt, parmesan, mozzarella, cheddar, feta, "
    "sour cream, cream cheese",
    "bakery": "bread, tortilla, bun, baguette, roll, pita, naan",
    "pantry": "flour, all-purpose flour, rice, pasta, spaghetti, noodle, oats, quinoa, lentil, bean, chickpea, breadcrumb, "
    "cornmeal",
    "canned & jarred": "canned, crushed tomatoes, diced tomatoes, tomato paste, tomato sauce, broth, stock, coconut milk",
    "condiments & sauces": "oil, olive oil, vegetable oil, sesame oil, soy sauce, vinegar, ketchup, mustard, mayonnaise, "
    "mayo, honey, oyster sauce, hot sauce, fish sauce, worcestershire, salsa, syrup, maple syrup",
    "spices & seasonings": "salt, pepper, black pepper, red pepper, cumin, paprika, cinnamon, oregano, thyme, rosemary, "
    "chili, chili powder, garlic powder, onion powder, bay leaf, nutmeg, turmeric, curry, cayenne, seasoning, red pepper flakes",
    "baking": "sugar, brown sugar, powdered sugar, baking powder, baking soda, yeast, vanilla, cocoa, chocolate, "
    "chocolate chip, cornstarch",
    "beverages": "wine, juice, coffee, tea, beer",
}
# Keywords that only the mobile variant has.
MOBILE_KEYWORDS = {"condiments & sauces": "miso, miso paste, hoisin, gochujang, tahini", "beverages": "sake"}

# Ingredients that nobody buys, matched as whole names.
EXCLUDED = (
    "water", "pasta water", "cold water", "warm water", "hot water", "ice water", "boiling water", "cooking water",
    "reserved pasta water", "lukewarm water", "room temperature water", "tap water", "filtered water",
)

# What marks a line as something else than an ingredient: words as whole tokens, phrases anywhere.
NOISE_WORDS = (
    # of a screen
    "search menu settings notification notifications wifi wi-fi bluetooth battery signal airplane hotspot brightness volume "
    "back home share bookmark widget app apps "
    # of a weather report
    "sunny cloudy rainy snowy windy stormy foggy overcast humidity forecast precipitation partly mostly "
    # of a recipe page
    "serves servings yield yields calories nutrition nutritional difficulty rating ratings review reviews advertisement"
).split()
NOISE_PHRASES = (
    "log in", "sign in", "sign up", "log out", "prep time", "cook time", "total time", "ready in", "print recipe",
    "save recipe", "jump to recipe", "internal temp", "internal temperature", "oven temperature",
)
TEMPERATURE = r"\d+\s*°\s*[cf]\b|\d+\s*degrees?\s*(celsius|fahrenheit|[cf])?\b"

# Whole lines that open an ingredient list or the section after it.
HEADING = r"(?i)^\s*(ingredients?|what you('| wi)ll need|shopping list)\s*:?\s*$"
NEXT_SECTION = r"(?i)^\s*(instructions?|directions?|method|steps?|preparation|notes?|nutrition)\s*:?\s*$"

# Words that open a step rather than an ingredient.
VERBS = (
    "preheat mix add bake stir combine pour whisk heat cook serve remove place cover season cut chop let transfer reduce "
    "simmer drain spread sprinkle garnish repeat continue meanwhile once using brown boil roast grill melt beat fold knead "
    "chill freeze marinate toss arrange line grease"
).split()

# Units, plural to singular.
UNITS = {
    "balls": "ball", "bags": "bag", "bars": "bar", "baskets": "basket", "batches": "batch", "blocks": "block", "bottles": "bottle", "boxes": "box",
    "branches": "branch", "buckets": "bucket", "bulbs": "bulb", "bunches": "bunch", "bundles": "bundle", "c": "c", "cans": "can",
    "canisters": "canister", "chunks": "chunk", "cloves": "clove", "clusters": "cluster", "counts": "count", "cl": "cl", "cL": "cL", "cubes": "cube",
    "cups": "cup", "cutlets": "cutlet", "dashes": "dash", "dessertspoons": "dessertspoon", "dollops": "dollop", "drops": "drop", "ears": "ear",
    "envelopes": "envelope", "feet": "foot", "fl": "fl", "floz": "floz", "g": "g", "gm": "gm", "gal": "gal", "gallons": "gallon", "glasses": "glass",
    "grams": "gram", "grinds": "grind", "handfuls": "handful", "heads": "head", "jars": "jar", "jiggers": "jigger", "kg": "kg",
    "kilograms": "kilogram", "knobs": "knob", "ladles": "ladle", "lbs": "lb", "leaves": "leaf", "lengths": "length", "links": "link", "l": "l",
    "liters": "liter", "litres": "litre", "loaves": "loaf", "milliliters": "milliliter", "millilitres": "millilitre", "ml": "ml", "mL": "mL",
    "mugs": "mug", "ounces": "ounce", "oz": "oz", "packs": "pack", "packages": "package", "packets": "packet", "pairs": "pair", "pieces": "piece",
    "pinches": "pinch", "pints": "pint", "pods": "pod", "pots": "pot", "pounds": "pound", "pts": "pt", "punnets": "punnet", "racks": "rack",
    "rashers": "rasher", "recipes": "recipe", "rectangles": "rectangle", "ribs": "rib", "quarts": "quart", "qt": "qt", "sachets": "sachet",
    "scoops": "scoop", "sections": "section", "segments": "segment", "shakes": "shake", "sheets": "sheet", "shots": "shot", "shoots": "shoot",
    "slabs": "slab", "slices": "slice", "sprigs": "sprig", "squares": "square", "stalks": "stalk", "stems": "stem", "sticks": "stick",
    "strips": "strip", "tablespoons": "tablespoon", "tbsps": "tbsp", "tbs": "tb", "teaspoons": "teaspoon", "tins": "tin", "tsps": "tsp",
    "tubs": "tub", "tubes": "tube", "twists": "twist", "units": "unit", "wedges": "wedge", "vials": "vial", "wheels": "wheel",
}

#: The same with a capital first letter too.
SINGULAR = UNITS | {p[0].upper() + p[1:]: s[0].upper() + s[1:] for p, s in UNITS.items()}
UNIT_WORDS = frozenset(SINGULAR) | frozenset(SINGULAR.values())

# Units of length, which are no units of amount.
LENGTH_UNITS = "centimeter centimetre cm in inch inches millimeter millimetre mm".split()
# Spellings of one unit.
UNIT_SYNONYMS = ("cup c", "gram g gm", "kilogram kg", "litre liter l", "ounce oz", "pound lb", "quart qt", "tablespoon tbsp tbs tb", "teaspoon tsp")
# Units that a parser recognises and gives in one spelling.
CANONICAL_UNITS = {
    "cup": "cup cups c", "gram": "gram grams g gm", "kilogram": "kilogram kilograms kg", "liter": "litre litres liter liters l",
    "milliliter": "millilitre millilitres milliliter milliliters ml mL", "centiliter": "centilitre centilitres centiliter centiliters cl cL",
    "fluid_ounce": "floz fluid_ounce", "millimeter": "millimetre millimetres millimeter millimeters mm", "ounce": "ounce ounces oz", "pound": "pound pounds lb lbs",
    "pint": "pint pints pt pts", "quart": "quart quarts qt", "gallon": "gallon gallons gal", "tablespoon": "tablespoon tablespoons tbsp tbsps tbs tb",
    "teaspoon": "teaspoon teaspoons tsp tsps",
}
# Short spellings and what they are read as, as whole words, one after another.
UNIT_REWRITES = {
    "fl oz": "floz", "fluid oz": "fluid_ounce", "fl ounce": "fluid_ounce", "fluid ounce": "fluid_ounce", "C": "cup", "c": "cup", "qt": "quart",
    "Cl": "centiliter", "G": "gram", "Ml": "milliliter", "Mm": "millimeter", "Pt": "pint", "Tb": "tablespoon",
}
# Words that are units of another kind elsewhere and are never recognised.
MISREAD_UNITS = ("pinch", "pinches", "bar", "bars", "link", "links", "shake", "shakes", "tin", "tins", "unit", "units", "fat")
# Size words before or after a unit.
SIZES = (
    "big bite-size bite-sized extra-large jumbo large lg little md medium medium-large medium-size medium-sized medium-small "
    "medium-to-large miniature regular slim sm small small-to-medium smaller smallest thick thin tiny"
).split()
# Numbers as words.
NUMBER_WORDS = {
    "one-quarter": "1/4", "one-half": "1/2", "three-quarter": "3/4", "three-quarters": "3/4", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14",
    "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
}
# Vulgar fractions.
FRACTIONS = {
    "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅙": "1/6", "⅚": "5/6", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5",
    "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "½": "1/2",
}


@dataclass(frozen=True)
class Config:
    """What the operators take from outside; the defaults are the fixed values above."""

    aisles: tuple[str, ...] = AISLES
    keywords: dict = field(default_factory=lambda: {a: k.split(", ") for a, k in KEYWORDS.items()})
    excluded: tuple[str, ...] = EXCLUDED
    most: float = 1000.0
    variant: str = "default"

    @staticmethod
    def mobile() -> Config:
        both = {a: k.split(", ") + MOBILE_KEYWORDS.get(a, "").split(", ") * (a in MOBILE_KEYWORDS) for a, k in KEYWORDS.items()}
        return Config(keywords=both, variant="mobile")

    def ranked_keywords(self) -> list[tuple[str, str]]:
        """(keyword, aisle), longest first, ties in table order."""
        pairs = [(k, aisle) for aisle, words in self.keywords.items() for k in words]
        return sorted(pairs, key=lambda p: -len(p[0]))


DEFAULT = Config()
