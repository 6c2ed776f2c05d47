"""Schemas and the class vocabulary of page layouts."""

from __future__ import annotations

# Class names, thresholds and ratios of the layout rules.
ANCHORS = ["question type", "question number", "second_question_number"]
CHILDREN = ["question text", "list", "choices", "figure", "table", "flowchart"]
VISUALS = ["figure", "table", "flowchart"]
SEPARATOR = "question type"
SEPARATOR_WIDTH, SEPARATOR_TOP = 0.8, 0.15
MIN_ANCHORS, MIN_COLUMN_GAP, COLUMN_MARGIN = 2, 50, 20
GAP_RATIO, GAP_PIXELS, DEFAULT_ANCHOR_HEIGHT = 1.5, 100, 30
SPLIT_Y, SPREAD_X = 0.4, 0.1
ADJACENT_Y, ADJACENT_X = 0.7, 50
TOP_ORPHANS = 0.15
NEAR, NEAR_X = 250, 0.2
LOOKAHEAD, MOVE_FROM, MOVE_RATIO = 2, 75, 0.5
IOU = 0.7
NUMBER_CLASSES = ["question number", "second_question_number"]
# classes whose texts are recognised; formulas come under both spellings
OCR_CLASSES = ["plain text", "unit", "question type", "question text", "question number", "title", "figure_caption", "table caption", "table footnote", "isolate_formula", "isolated_formula", "formula_caption", "list", "choices", "page", "second_question_number"]
DPI, PAGE_INCHES, MIN_DPI, MAX_DPI = 300.0, 11.69, 120.0, 600.0
WIDE_INCHES, WIDE_MARGIN = 9.0, 0.75

ELEMENT = (
    "element_id long, page_id long, class_name string, confidence double, bbox_x int, bbox_y int, bbox_width int, bbox_height int"
)
#: Columns of the element table in this order.
ELEMENT_COLUMNS = [c.split()[0] for c in ELEMENT.split(", ")]

CLASS_NAMES = {
    0: "question type", 1: "question number", 2: "second_question_number", 3: "question text", 4: "list", 5: "choices",
    6: "figure", 7: "table", 8: "flowchart", 9: "plain text", 10: "title", 11: "unit",
}

# id, name, layout model (a deployment's own names), sorting method.
DOCUMENT_TYPES = [
    (1, "worksheet", "worksheet-layout", "question_based"),
    (2, "document", "document-layout", "reading_order"),
]

# Prefix, suffix, indent, transform, allow_empty of each document type's classes.
FORMATTING_RULES = [
    ("question_based", "question type", "\n\n[", "]\n", 0, "normalize_question_type", False),
    ("question_based", "question number", "\n\n", ". ", 0, None, False),
    ("question_based", "second_question_number", "\n   ", "", 3, None, False),
    ("question_based", "question text", "", "\n", 3, None, False),
    ("question_based", "plain text", "", "\n", 0, None, False),
    ("question_based", "unit", "", "\n", 3, None, False),
    ("question_based", "list", "   - ", "\n", 0, "normalize_list", False),
    ("question_based", "choices", "", "\n", 3, "normalize_choices", False),
    ("question_based", "figure", "\n   [그림 설명]\n", "\n\n", 3, "merge_visual_description", True),
    ("question_based", "table", "\n   [표 설명]\n", "\n\n", 3, "merge_visual_description", True),
    ("question_based", "flowchart", "\n   [순서도 설명]\n", "\n\n", 3, "merge_visual_description", True),
    ("question_based", "figure_caption", "   (그림 캡션) ", "\n\n", 0, None, False),
    ("question_based", "table caption", "   (표 캡션) ", "\n\n", 0, None, False),
    ("question_based", "table footnote", "     * ", "\n", 0, None, False),
    ("question_based", "formula_caption", "   (수식 설명) ", "\n", 0, None, False),
    ("question_based", "isolated_formula", "\n   [수식]\n", "\n", 3, "isolate_formula", False),
    ("reading_order", "title", "", "\n\n", 0, "uppercase_title", False),
    ("reading_order", "heading", "\n", "\n\n", 0, None, False),
    ("reading_order", "plain text", "", "\n\n", 0, None, False),
    ("reading_order", "list", "", "\n", 0, "normalize_reading_list", False),
    ("reading_order", "figure", "\n[그림] ", "\n\n", 0, "merge_visual_description", False),
    ("reading_order", "table", "\n[표] ", "\n\n", 0, "merge_visual_description", False),
    ("reading_order", "figure_caption", "(그림 캡션) ", "\n", 0, None, False),
    ("reading_order", "table caption", "(표 캡션) ", "\n", 0, None, False),
    ("reading_order", "table footnote", "* ", "\n", 0, None, False),
]
