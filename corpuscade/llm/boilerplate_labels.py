"""Labelled text blocks: the features of boilerplate.FEATURES, then 1 for boilerplate and 0 for main body.

145 rows are blocks drawn over the kinds of markup and labelled by reading them; the first ten
rows are features written down by hand for bylines and prompts of small sites, of which the
drawn blocks had none.  The table is bounded to fewer than 200 rows; the classifier is trained
from it each time it is needed.
"""

# The labelled blocks.
LABELLED = (
    (5, 0.0, 7, 0.0, 45, 0.0, 1, 0, 1, 7, 1, 1),
    (5, 0.0, 31, 0.0, 6, 0.0, 1, 0, 1, 8, 1, 1),
    (5, 0.0, 12, 0.0, 58, 0.0, 1, 0, 1, 3, 1, 1),
    (6, 0.0, 48, 0.0, 7, 0.0, 1, 0, 1, 5, 1, 1),
    (7, 0.0, 7, 0.0, 22, 0.0, 1, 0, 1, 2, 1, 1),
    (5, 0.0, 6, 0.0, 40, 0.0, 1, 1, 1, 6, 1, 1),
    (7, 0.0, 33, 0.0, 8, 0.0, 1, 1, 1, 3, 0, 1),
    (7, 0.0, 5, 0.0, 51, 0.0, 1, 1, 1, 5, 0, 1),
    (5, 0.0, 60, 0.0, 7, 0.0, 1, 1, 1, 2, 1, 1),
    (5, 0.0, 3, 0.0, 15, 0.0, 1, 1, 1, 1, 0, 1),
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0, 65, 0, 1),
    (1, 0.0, 0, 0.0, 3, 0.0, 0, 3, 0, 35, 0, 1),
    (1, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0, 65, 0, 1),
    (1, 0.0, 1, 0.0, 3, 0.0, 0, 1, 0, 51, 0, 1),
    (1, 0.0, 1, 0.0, 3, 0.0, 0, 3, 0, 40, 0, 1),
    (1, 0.0, 3, 0.0, 1, 0.0, 0, 1, 0, 71, 0, 1),
    (1, 0.0, 3, 0.0, 8, 0.0, 0, 0, 0, 50, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 2, 0, 24, 0, 1),
    (1, 1.0, 1, 1.0, 3, 1.0, 0, 2, 0, 196, 0, 1),
    (2, 0.0, 1, 0.0, 2, 0.0, 0, 3, 0, 31, 0, 1),
    (2, 1.0, 3, 1.0, 1, 1.0, 0, 2, 0, 87, 0, 1),
    (3, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 71, 0, 1),
    (3, 0.0, 1, 0.0, 1, 0.0, 0, 3, 0, 35, 1, 1),
    (3, 0.0, 2, 0.0, 1, 0.0, 0, 3, 0, 101, 0, 1),
    (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1, 2, 0, 0),
    (3, 0.0, 3, 0.0, 7, 0.0, 1, 0, 1, 4, 0, 0),
    (3, 0.0, 3, 0.0, 8, 0.0, 0, 0, 1, 19, 1, 1),
    (3, 0.0, 3, 0.0, 47, 0.0, 1, 0, 1, 4, 0, 0),
    (3, 0.0, 20, 0.0, 5, 0.0, 0, 1, 1, 23, 1, 1),
    (3, 0.0, 24, 0.0, 3, 0.0, 1, 0, 1, 3, 0, 0),
    (3, 1.0, 0, 0.0, 1, 1.0, 0, 2, 0, 53, 1, 1),
    (4, 0.0, 1, 0.0, 14, 0.0, 1, 0, 1, 1, 0, 0),
    (4, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0, 26, 0, 1),
    (4, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1, 1, 0, 1),
    (4, 0.0, 6, 0.0, 7, 0.0, 0, 2, 1, 60, 1, 1),
    (4, 0.0, 6, 0.0, 12, 0.0, 0, 0, 1, 26, 0, 1),
    (4, 0.0, 18, 0.0, 7, 0.0, 0, 1, 0, 40, 1, 1),
    (4, 0.0, 41, 0.0, 7, 0.0, 0, 1, 1, 41, 0, 1),
    (5, 0.0, 3, 0.0, 3, 0.0, 1, 1, 1, 18, 1, 1),
    (5, 0.0, 3, 0.0, 6, 0.0, 0, 1, 0, 1, 0, 1),
    (5, 0.0, 4, 0.0, 21, 0.0, 1, 2, 1, 2, 0, 1),
    (5, 0.0, 4, 0.0, 60, 0.0, 1, 0, 1, 37, 1, 1),
    (5, 0.0, 5, 0.0, 35, 0.0, 1, 0, 1, 21, 1, 1),
    (5, 0.0, 5, 0.0, 38, 0.0, 1, 0, 1, 22, 1, 1),
    (5, 0.0, 5, 0.0, 42, 0.0, 1, 2, 1, 22, 1, 1),
    (5, 0.0, 5, 0.0, 55, 0.0, 1, 0, 1, 21, 1, 1),
    (5, 0.0, 6, 0.0, 29, 0.0, 1, 0, 1, 23, 1, 1),
    (5, 0.0, 6, 0.0, 36, 0.0, 1, 2, 1, 39, 1, 1),
    (5, 0.0, 6, 0.0, 52, 0.0, 1, 0, 1, 33, 1, 1),
    (5, 0.0, 6, 0.0, 63, 0.0, 1, 2, 1, 52, 1, 1),
    (5, 0.0, 7, 0.0, 4, 0.0, 1, 0, 1, 39, 1, 1),
    (5, 0.0, 7, 0.0, 51, 0.0, 1, 1, 1, 83, 1, 1),
    (5, 0.0, 7, 0.0, 58, 0.0, 1, 0, 1, 37, 1, 1),
    (5, 0.0, 15, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (5, 0.0, 31, 0.0, 22, 0.0, 1, 0, 1, 26, 0, 1),
    (5, 0.0, 45, 0.0, 36, 0.0, 1, 1, 1, 18, 1, 1),
    (5, 0.0, 51, 0.0, 57, 0.0, 1, 0, 1, 23, 1, 1),
    (5, 0.0, 56, 0.0, 29, 0.0, 1, 0, 1, 23, 1, 1),
    (6, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1, 2, 0, 0),
    (6, 0.0, 6, 0.0, 7, 0.0, 1, 0, 1, 2, 0, 0),
    (6, 0.0, 7, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (6, 0.0, 7, 0.0, 7, 0.0, 1, 0, 1, 2, 0, 0),
    (6, 0.0, 8, 0.0, 42, 0.0, 1, 0, 1, 11, 1, 1),
    (6, 0.0, 26, 0.0, 13, 0.0, 1, 0, 1, 8, 1, 1),
    (6, 0.0, 48, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (7, 0.0, 1, 0.0, 4, 0.0, 0, 0, 0, 1, 0, 1),
    (7, 0.0, 3, 0.0, 4, 0.0, 1, 0, 1, 4, 0, 0),
    (7, 0.0, 3, 0.0, 54, 0.0, 1, 0, 1, 1, 0, 0),
    (7, 0.0, 4, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (7, 0.0, 5, 0.0, 12, 0.0, 1, 0, 1, 24, 1, 1),
    (7, 0.0, 5, 0.0, 44, 0.0, 1, 0, 1, 1, 0, 0),
    (7, 0.0, 5, 0.0, 59, 0.0, 1, 0, 1, 46, 0, 1),
    (7, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1, 3, 0, 0),
    (7, 0.0, 6, 0.0, 25, 0.0, 1, 1, 1, 45, 0, 1),
    (7, 0.0, 6, 0.0, 52, 0.0, 1, 1, 1, 36, 0, 1),
    (7, 0.0, 7, 0.0, 6, 0.0, 1, 0, 1, 48, 0, 1),
    (7, 0.0, 7, 0.0, 6, 0.0, 1, 2, 1, 20, 0, 1),
    (7, 0.0, 7, 0.0, 8, 0.0, 0, 1, 1, 127, 1, 1),
    (7, 0.0, 7, 0.0, 8, 0.0, 1, 0, 1, 64, 1, 1),
    (7, 0.0, 7, 0.0, 8, 0.0, 1, 0, 1, 91, 1, 1),
    (7, 0.0, 10, 0.0, 48, 0.0, 1, 0, 1, 1, 0, 0),
    (7, 0.0, 13, 0.0, 7, 0.0, 0, 0, 1, 46, 0, 1),
    (7, 0.0, 14, 0.0, 7, 0.0, 1, 0, 1, 54, 0, 1),
    (7, 0.0, 15, 0.0, 11, 0.0, 1, 0, 1, 48, 0, 1),
    (7, 0.0, 18, 0.0, 46, 0.0, 1, 0, 1, 3, 0, 0),
    (7, 0.0, 20, 0.0, 7, 0.0, 1, 0, 1, 46, 0, 1),
    (7, 0.0, 38, 0.0, 14, 0.0, 1, 0, 1, 48, 0, 1),
    (7, 0.0, 39, 0.0, 34, 0.0, 1, 1, 1, 111, 0, 1),
    (7, 0.0, 49, 0.0, 0, 0.0, 0, 0, 1, 73, 0, 1),
    (7, 0.0, 59, 0.0, 7, 0.0, 1, 0, 1, 48, 0, 1),
    (8, 0.0, 6, 0.0, 51, 0.0, 1, 0, 1, 1, 0, 0),
    (8, 0.0, 7, 0.0, 16, 0.0, 0, 1, 1, 127, 1, 1),
    (8, 0.0, 7, 0.0, 16, 0.0, 1, 0, 1, 64, 1, 1),
    (8, 0.0, 7, 0.0, 84, 0.0, 1, 0, 1, 91, 1, 1),
    (8, 0.0, 14, 0.0, 9, 0.0, 0, 2, 1, 39, 1, 1),
    (8, 0.0, 30, 0.0, 5, 0.0, 1, 0, 1, 2, 0, 0),
    (9, 0.0, 1, 0.0, 4, 0.0, 0, 3, 0, 1, 0, 1),
    (9, 0.0, 3, 0.0, 50, 0.0, 1, 0, 1, 8, 0, 0),
    (9, 0.0, 3, 0.0, 66, 0.0, 1, 0, 1, 8, 0, 0),
    (9, 0.0, 12, 0.0, 20, 0.0, 0, 0, 0, 1, 0, 1),
    (9, 1.0, 1, 1.0, 4, 0.0, 0, 2, 0, 2, 0, 1),
    (10, 0.0, 7, 0.0, 7, 0.0, 0, 1, 1, 2, 0, 1),
    (11, 0.0, 6, 0.0, 29, 0.0, 1, 0, 1, 1, 0, 0),
    (11, 0.0, 64, 0.0, 7, 0.0, 1, 0, 1, 1, 0, 0),
    (11, 1.0, 0, 0.0, 8, 0.0, 0, 2, 0, 1, 0, 1),
    (12, 0.0, 47, 0.0, 4, 0.0, 1, 0, 1, 7, 0, 0),
    (13, 0.0, 3, 0.0, 9, 0.0, 0, 0, 1, 2, 0, 1),
    (13, 0.0, 5, 0.0, 27, 0.0, 1, 0, 1, 6, 0, 0),
    (14, 0.0, 4, 0.0, 63, 0.0, 1, 0, 1, 4, 0, 0),
    (15, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (15, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1, 5, 0, 0),
    (15, 0.0, 7, 0.0, 6, 0.0, 1, 0, 1, 7, 0, 0),
    (15, 0.0, 10, 0.0, 13, 0.0, 1, 0, 1, 1, 0, 0),
    (15, 0.0, 23, 0.0, 53, 0.0, 1, 0, 1, 1, 0, 0),
    (16, 0.0, 8, 0.0, 0, 0.0, 0, 2, 1, 130, 1, 1),
    (16, 0.0, 8, 0.0, 40, 0.0, 1, 0, 1, 64, 1, 1),
    (17, 0.0, 4, 0.0, 8, 0.0, 0, 2, 1, 1, 0, 1),
    (17, 0.0, 9, 0.0, 0, 0.0, 0, 2, 1, 46, 1, 1),
    (17, 0.0, 33, 0.0, 6, 0.0, 1, 0, 1, 7, 0, 0),
    (18, 0.0, 1, 0.0, 7, 0.0, 0, 1, 0, 59, 1, 1),
    (18, 0.0, 47, 0.0, 41, 0.0, 1, 0, 1, 2, 0, 0),
    (19, 0.0, 43, 0.0, 7, 0.0, 0, 2, 1, 20, 1, 1),
    (20, 0.0, 6, 0.0, 7, 0.0, 1, 0, 1, 26, 1, 1),
    (21, 0.0, 3, 0.0, 36, 0.0, 1, 0, 1, 4, 0, 0),
    (22, 0.0, 5, 0.0, 13, 0.0, 1, 0, 1, 7, 0, 0),
    (23, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1, 5, 0, 0),
    (23, 0.0, 4, 0.0, 0, 0.0, 1, 0, 1, 4, 0, 0),
    (23, 0.0, 4, 0.0, 4, 0.0, 0, 0, 1, 1, 0, 1),
    (26, 0.0, 4, 0.0, 27, 0.0, 1, 0, 1, 4, 0, 0),
    (26, 0.0, 5, 0.0, 5, 0.0, 1, 2, 1, 1, 0, 1),
    (26, 0.0, 77, 0.0, 69, 0.0, 1, 0, 1, 2, 0, 0),
    (27, 0.0, 27, 0.0, 55, 0.0, 1, 0, 1, 1, 0, 0),
    (28, 0.0, 4, 0.0, 53, 0.0, 1, 0, 1, 1, 0, 0),
    (28, 0.0, 35, 0.0, 7, 0.0, 1, 0, 1, 1, 0, 0),
    (29, 0.0, 4, 0.0, 3, 0.0, 1, 0, 1, 1, 0, 0),
    (30, 0.0, 6, 0.0, 7, 0.0, 1, 0, 1, 2, 0, 0),
    (30, 0.0, 18, 0.0, 13, 0.0, 1, 0, 1, 1, 0, 0),
    (33, 0.0, 4, 0.0, 47, 0.0, 1, 0, 1, 1, 0, 0),
    (38, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1, 4, 0, 0),
    (39, 0.0, 7, 0.0, 4, 0.0, 1, 0, 1, 1, 0, 0),
    (41, 0.0, 7, 0.0, 40, 0.0, 1, 0, 1, 3, 0, 0),
    (43, 0.0, 10, 0.0, 3, 0.0, 1, 0, 1, 1, 0, 0),
    (43, 0.0, 31, 0.0, 16, 0.0, 1, 0, 1, 1, 0, 0),
    (45, 0.0, 38, 0.0, 8, 0.0, 1, 0, 1, 1, 0, 0),
    (51, 0.0, 62, 0.0, 7, 0.0, 1, 0, 1, 1, 0, 0),
    (52, 0.0, 48, 0.0, 6, 0.0, 1, 0, 1, 1, 0, 0),
    (53, 0.0, 14, 0.0, 76, 0.0, 1, 0, 1, 1, 0, 0),
    (55, 0.0, 7, 0.0, 7, 0.0, 1, 0, 1, 2, 0, 0),
    (56, 0.0, 7, 0.0, 60, 0.0, 1, 0, 1, 2, 0, 0),
    (60, 0.0, 4, 0.0, 13, 0.0, 1, 0, 1, 1, 0, 0),
    (60, 0.0, 65, 0.0, 4, 0.0, 1, 0, 1, 3, 0, 0),
    (61, 0.0, 21, 0.0, 45, 0.0, 1, 0, 1, 1, 0, 0),
    (63, 0.0, 12, 0.0, 14, 0.0, 1, 0, 1, 1, 0, 0),
    (65, 0.0, 54, 0.0, 5, 0.0, 1, 0, 1, 1, 0, 0),
    (88, 0.0, 51, 0.0, 7, 0.0, 1, 0, 1, 1, 0, 0),
)
