"""What the law, the forms, the file formats and the contract of the rules (thresholds, synonyms) prescribe."""

BEVERAGE_TYPES = ("distilled_spirits", "wine", "malt_beverage")
BEVERAGE_ALIASES = {
    "distilledspirits": "distilled_spirits",
    "spirits": "distilled_spirits",
    "distilled": "distilled_spirits",
    "liquor": "distilled_spirits",
    "wine": "wine",
    "maltbeverage": "malt_beverage",
    "malt": "malt_beverage",
    "beer": "malt_beverage",
}
DEFAULT_BEVERAGE = "distilled_spirits"

# Thresholds of the rules
REVIEW_SIMILARITY = 0.82
MIN_CONFIDENCE = 0.5
MIN_IMAGE_SCORE = 0.5
MARGINAL_LEGIBILITY = 0.6
MIN_RELATIVE_CONTRAST = 0.5

# Alcohol statements
ABV_TOLERANCE = {"distilled_spirits": 0.3, "malt_beverage": 0.3}
WINE_TOLERANCE_TO_14, WINE_TOLERANCE_ABOVE = 1.5, 1.0
MAX_ABV, MAX_PROOF, PROOF_SLACK = 95.0, 190.0, 1.0
VULGAR_FRACTIONS = {
    "½": ".5", "¼": ".25", "¾": ".75", "⅓": ".333", "⅔": ".667", "⅕": ".2", "⅖": ".4",
    "⅗": ".6", "⅘": ".8", "⅙": ".167", "⅛": ".125", "⅜": ".375", "⅝": ".625", "⅞": ".875",
}

# Volumes, in millilitres
UNITS_ML = {
    "ml": 1.0, "milliliter": 1.0, "millilitre": 1.0, "milliliters": 1.0, "millilitres": 1.0,
    "cl": 10.0, "centiliter": 10.0, "centilitre": 10.0, "centiliters": 10.0, "centilitres": 10.0,
    "dl": 100.0,
    "l": 1000.0, "liter": 1000.0, "litre": 1000.0, "liters": 1000.0, "litres": 1000.0,
    "fl oz": 29.5735, "floz": 29.5735, "fluid ounce": 29.5735, "fluid ounces": 29.5735, "oz": 29.5735,
    "pint": 473.176, "pints": 473.176, "quart": 946.353, "quarts": 946.353, "gallon": 3785.41, "gallons": 3785.41,
}
STANDARDS_OF_FILL = {
    "distilled_spirits": [50, 100, 187, 200, 250, 331, 350, 355, 375, 475, 500, 570, 700, 710, 720, 750, 900, 945, 1000, 1500, 1750, 1800, 2000, 3000, 3750],
    "wine": [50, 100, 180, 187, 200, 250, 300, 330, 355, 360, 375, 473, 500, 550, 568, 600, 620, 700, 720, 750, 1000, 1500, 1800, 2250, 3000],
}
FILL_SLACK_ML, EQUAL_VOLUME_ML = 1.0, 0.5
WINE_LITRES_FROM_ML, WINE_SCOPE_ML, LITRE_SLACK = 4000.0, 18000.0, 0.001

# Wording
STATUTORY_WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
WARNING_HEADER = "GOVERNMENT WARNING:"
APOSTROPHES = "‘’ʼʹ′`´"
DASHES = "‐‑‒–—―−"
QUOTES = "“”„«»″"
TOKEN_SYNONYMS = {
    "alc": "alcohol", "alch": "alcohol", "alco": "alcohol", "vol": "volume", "abv": "alcoholbyvolume", "whisky": "whiskey",
    "inc": "incorporated", "co": "company", "corp": "corporation", "ltd": "limited", "llc": "limitedliabilitycompany", "bros": "brothers",
    "dist": "distillery", "distillers": "distillery", "distilling": "distillery",
    "ml": "millilitre", "mls": "millilitre", "milliliter": "millilitre", "milliliters": "millilitre", "millilitres": "millilitre",
    "l": "litre", "liter": "litre", "liters": "litre", "litres": "litre", "cl": "centilitre", "centiliter": "centilitre", "centiliters": "centilitre",
}
NOISE_TOKENS = ("the", "a", "an", "of")

# Pictures
INK_PERCENTILE, PAPER_PERCENTILE = 0.02, 0.90
WHOLE_LABEL = (0.02, 0.02, 0.96, 0.96)
INSET, MIN_BOX = 0.05, (8, 4)
SUPPORTED_IMAGES = ("image/png", "image/jpeg", "image/webp", "image/gif")
MAX_IMAGE_BYTES, MAX_FIELD_CHARS, MAX_APPLICATION_CHARS = 8 * 1024 * 1024, 300, 8192
MAX_EDGE_PIXELS, SMALL_IMAGE_BYTES = 1568, 400 * 1024

# Flow
RATE_LIMIT, RATE_WINDOW_MS = 400, 60_000
#: Clients whose windows a limiter keeps; beyond, the oldest go.
MOST_CLIENTS = 10_000
BUDGET_MS, BACKOFF_FIRST_MS, BACKOFF_MOST_MS = 5000, 500, 15_000
VERDICT_RANK = {"fail": 0, "unreadable": 1, "review": 2, "pass": 3, "not_applicable": 4}
