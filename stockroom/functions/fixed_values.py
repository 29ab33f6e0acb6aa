"""Values that results depend on. They are data, not logic: fixed values, in their natural order."""

#: Destination sheets, in output order.
SHEETS = ["Microwaves", "DishWashers", "Fridges & Freezers", "Rangehoods", "Cooktops", "Ovens"]

#: Fixed value: a rule's block that stands for the row's own subcategory.
USE_SUBCATEGORY = "__USE_SUBCATEGORY__"

#: Routing rules (product group, subcategory terms, sheet, block), first match wins.
RULES = [
    ("Cooking", ["Built-in Microwave"], "Microwaves", "Built-in"),
    ("Cooking", ["Microwave Oven", "Microwave"], "Microwaves", "Freestanding"),
    ("Cooking", ["Freestanding Cooker", "Range Cooker", "Freestanding Range"], "Ovens", "Freestanding"),
    ("Cooking", ["Built-in Oven", "Pyrolytic Oven", "Double Oven", "Speed Oven", "Steam Combination Oven", "Steam Oven", "Compact Oven", "Wall Oven"], "Ovens", "Built-in"),
    ("Cooking", ["Induction Cooktop", "Induction Hob"], "Cooktops", "Induction"),
    ("Cooking", ["Gas Cooktop", "Gas Hob"], "Cooktops", "Gas"),
    ("Cooking", ["Ceramic Cooktop", "Electric Cooktop", "Vitroceramic Cooktop", "Ceramic Hob"], "Cooktops", "Ceramic"),
    ("Cooking", ["Rangehood", "Range Hood", "Hood", "Canopy", "DownDraft", "Downdraft", "Undermount", "Slide Out", "Slideout"], "Rangehoods", "__USE_SUBCATEGORY__"),
    ("Dishwashing", [], "DishWashers", "Dishwasher"),
    ("Refrigeration", ["French Door", "Side by Side", "Top Mount", "Bottom Mount", "Quad Door", "Single Door", "Column Refrigerator", "Integrated Fridge", "Multi-Door"], "Fridges & Freezers", "Fridge"),
    ("Refrigeration", ["Chest Freezer", "Upright Freezer", "Column Freezer", "Integrated Freezer", "Freezer"], "Fridges & Freezers", "Freezer"),
    ("Refrigeration", ["Wine Cabinet", "Wine Cooler", "Wine Fridge", "Beverage Centre", "Beverage Center", "Beverage Fridge"], "Fridges & Freezers", "Beverage Fridge"),
]

#: Override rules (product group, trigger terms, [(fields, keywords, sheet, block)]).
OVERRIDES = [
    (
        "Refrigeration",
        ["Specialty"],
        [
            (["Product Name", "Model / SKU"], ["Freezer"], "Fridges & Freezers", "Freezer"),
            (["Product Name", "Model / SKU"], ["Wine", "Beverage"], "Fridges & Freezers", "Beverage Fridge"),
            (["Product Name", "Model / SKU"], ["Fridge", "Refrigerator"], "Fridges & Freezers", "Fridge"),
        ],
    )
]

#: Reasons of unmapped rows; {group} and {subcategory} are the trimmed originals.
MISSING_GROUP = "Missing Product Group"
UNKNOWN_GROUP = "No M10 sheet for Product Group '{group}'"
UNKNOWN_SUBCATEGORY = "No mapping for subcategory '{subcategory}' in Product Group '{group}'"
UNKNOWN = "Unknown"

#: Output headers.
MAPPED_HEADERS = ["Brand", "Product", "Height", "Width", "Depth", "Link"]
RESULT_HEADERS = ["Dimension Confidence", "Dimension Source"]
UNMAPPED_HEADERS = ["Brand", "Product Group", "Subcategory", "Model / SKU", "Product Name", "Reason Not Mapped", "Link"]
REVIEW_HEADERS = ["Brand", "SKU", "Sheet", "Confidence", "Source URL", "Reason", "Raw Text"]

#: Confidences and reasons of results.
RESOLVED, NEEDS_REVIEW, NOT_FOUND = "Resolved", "Needs Review", "Not Found"
NO_URL = "No product URL available"
NO_PARSER_YET = "Adapter not yet implemented"
NO_PARSER = "No adapter implemented for brand '{brand}'"
CONFLICT = "Conflicting dimension values found on page"
PARTIAL = "Partial dimensions found: H={h} W={w} D={d}"
NOTHING_FOUND = "No dimension data found on page or linked PDFs"
FETCH_FAILED = "fetch failed"
SKIPPED = "[Cavity dims skipped]: "

#: Brands with a page parser, and brands whose parser is still to come.
PARSED_BRANDS = ["lg"]
AWAITED_BRANDS = ["bosch", "samsung"]

#: Patterns (Java syntax).
DIMENSION_LABEL = r"(?iU)\b(net\s+dimension|gross\s+dimension|overall\s+dimension|product\s+dimension|unit\s+dimension|dimension|width|height|depth)\b"
CAVITY_LABEL = r"(?iU)\b(cutout|cut[\s-]out|cavity|recess|installation|opening)\b"
OVERALL_LABEL = r"(?iU)\b(net|overall|total|product|unit|external|outer)\b"
UNIT = r"(?i)\((mm|cm|m)\)"
RANGE_SIGN = r"(?U)\s*[-–]\s*"
AXIS_TRIPLET = r"(?U)([WHDwhd])\s*[×xX*]\s*([WHDwhd])\s*[×xX*]\s*([WHDwhd])"
NUMBER = r"(?U)\d+(?:\s*[-–]\s*\d+)?"
TEXT_PAIR = r"(?U)^(.{3,60}?)\s*[:\t]\s*(.+)$"
LINE_END = r"\R"

#: Words of a label that name a single axis; the first that occurs as a substring decides.
SINGLE_AXIS = [("width", "W"), ("w", "W"), ("height", "H"), ("h", "H"), ("depth", "D"), ("d", "D")]

#: How many lines, skipped lines, numbers and document pages count.
RAW_LINES, SKIPPED_LINES, TRIPLET_NUMBERS, DOCUMENT_PAGES = 12, 4, 3, 8

#: Cells that a text landing reads as empty.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
