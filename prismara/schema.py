"""Schemas and fixed values of image collections."""

from __future__ import annotations

from pyspark.sql import types as T

# Image extensions, in lower case.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif", ".gif")
# Extensions tried for an image beside its record.
SIBLING_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")
# Tag categories.
CHARACTER, RATING = 4, 9
# Rating tags.
RATINGS = ("explicit", "questionable", "sensitive", "general")
# Tags that are never admitted.
BLOCKED_TAGS = ("no_humans", "text_focus", "implied_fellatio")
# Substrings of tags that are admitted only on explicit images.
MATURE_ADMISSION = (
    "nude", "sex", "penis", "vagina", "nipple", "pussy", "breast", "cum", "genital", "anus", "orgasm", "erect", "pubic", "naked",
    "masturbat", "porn", "hentai", "dildo", "bondage", "tentacle", "unskirt", "cameltoe", "areola", "groin", "topless", "bottomless",
)
# Substrings of tags that metadata lists as mature.
MATURE_METADATA = (
    "nude", "sex", "penis", "vagina", "nipple", "pussy", "ass", "breast", "cum", "genital", "anus", "orgasm", "erect", "pubic", "naked",
    "masturbat", "porn", "hentai", "dildo", "bondage", "rape", "tentacle",
)
# Tags too generic to name an image by.
GENERIC_TAGS = (
    "monochrome", "greyscale", "no_humans", "negative_space", "simple_background", "white_background", "black_background",
    "transparent_background", "sketch", "lineart", "comic", "manga", "gradient_background", "pattern_background",
)
# Tags never used in the name of a cluster.
NAMELESS_TAGS = (
    *GENERIC_TAGS, "traditional_media", "watercolor_(medium)", "pixel_art", "oikakeko", "highres", "absurdres", "commentary_request",
    "commentary", "translated", "bad_id", "bad_pixiv_id", "revision", "character_request",
)
# The tag groups of the semantic vector, in order. The complement of "nude" comes second.
TAG_GROUPS = {
    "nude": ("nude", "unskirt", "nipples", "pussy", "penis", "breasts", "cleavage", "underwear", "bikini", "swimsuit", "naked"),
    "not_nude": (),
    "stand": ("standing", "on_one_leg"),
    "sit": ("sitting", "kneeling", "squatting", "seiza", "crossed_legs"),
    "lie": ("lying", "on_stomach", "on_back", "on_side"),
    "shirt": ("shirt", "t-shirt", "collared_shirt", "blouse", "tank_top", "sweater", "hoodie"),
    "jacket": ("jacket", "coat", "cardigan", "suit_jacket", "cloak"),
    "dress": ("dress", "sundress", "wedding_dress"),
    "skirt": ("skirt", "pleated_skirt", "miniskirt", "pencil_skirt"),
    "pants": ("pants", "jeans", "shorts", "sweatpants", "trousers", "leggings"),
    "indoor": ("indoors", "bedroom", "classroom", "office", "kitchen", "bathroom", "living_room"),
    "outdoor": ("outdoors", "sky", "cloud", "street", "road", "bridge"),
    "nature": ("nature", "forest", "mountain", "ocean", "lake", "river", "field", "tree", "flower"),
    "urban": ("city", "building", "skyscraper", "cityscape", "town", "alley"),
    "black": ("black_hair",),
    "blonde": ("blonde_hair", "light_brown_hair"),
    "brown": ("brown_hair",),
    "red": ("red_hair", "pink_hair"),
    "blue": ("blue_hair", "aqua_hair"),
    "white": ("white_hair", "grey_hair", "silver_hair"),
    "green": ("green_hair",),
    "purple": ("purple_hair",),
    "happy": ("smile", "grin", "laughing", "open_mouth", ":d"),
    "sad": ("crying", "tears", "frown", "sad"),
    "angry": ("angry", "furrowed_brow", "clenched_teeth"),
    "neutral": ("expressionless", "closed_mouth", "serious"),
}
CHARACTER_SLOTS = 38

_D, _S = T.DoubleType(), T.StringType()
IMAGE_META = T.StructType(
    [
        T.StructField("rating", T.StructType([T.StructField(r, _D) for r in RATINGS])),
        T.StructField("general_tags", T.ArrayType(_S)),
        T.StructField("character_tags", T.ArrayType(_S)),
        T.StructField("mature_tags", T.ArrayType(_S)),
        T.StructField("all_scores", T.MapType(_S, _D)),
        T.StructField("error", _S),
    ]
)
FOLDER_META = T.StructType([T.StructField("folder", _S), T.StructField("total_images", T.LongType()), T.StructField("sampled", T.LongType()), T.StructField("images", T.MapType(_S, IMAGE_META))])
