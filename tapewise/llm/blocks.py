"""Labelled text blocks from which the tree of `html` is trained."""

import numpy as np

# Written by hand from typical pages. Text that is the article or not by its own shape: inside article or main, heading,
# paragraph, words, link density, words and link density of the block before, the same of the block after; 1 if it is main text.
SHAPES = [
    # Inside the article: titles, paragraphs of any length, list items, captions, quotations
    (1, 1, 0, 8, 0.0, 0, 0.0, 64, 0.0, 1),
    (1, 1, 0, 14, 0.0, 0, 0.0, 14, 0.0, 1),
    (1, 1, 0, 3, 0.0, 90, 0.0, 41, 0.1, 1),
    (1, 1, 0, 5, 1.0, 0, 0.0, 120, 0.0, 1),
    (1, 1, 0, 4, 0.0, 5, 0.0, 0, 0.0, 1),
    (1, 0, 1, 64, 0.0, 8, 0.0, 210, 0.0, 1),
    (1, 0, 1, 210, 0.0, 64, 0.0, 35, 0.1, 1),
    (1, 0, 1, 35, 0.2, 210, 0.0, 1, 0.0, 1),
    (1, 0, 1, 1, 0.0, 35, 0.1, 4, 0.0, 1),
    (1, 0, 1, 4, 0.0, 1, 0.0, 12, 0.0, 1),
    (1, 0, 1, 2, 0.0, 2, 0.0, 0, 0.0, 1),
    (1, 0, 1, 1, 0.0, 3, 0.0, 2, 0.0, 1),
    (1, 0, 1, 6, 1.0, 80, 0.0, 55, 0.0, 1),
    (1, 0, 1, 6, 1.0, 7, 0.0, 3, 0.0, 1),
    (1, 0, 1, 9, 0.8, 30, 0.0, 44, 0.1, 1),
    (1, 0, 1, 5, 1.0, 20, 0.0, 4, 1.0, 1),
    (1, 0, 1, 4, 1.0, 5, 1.0, 30, 0.1, 1),
    (1, 0, 0, 18, 0.5, 12, 0.0, 33, 1.0, 1),
    (1, 0, 0, 140, 0.0, 9, 0.0, 15, 0.0, 1),
    (1, 0, 0, 11, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 0, 3, 0.0, 2, 0.0, 4, 0.0, 1),
    (1, 0, 0, 2, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 1, 480, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 1, 22, 0.0, 7, 0.0, 14, 0.0, 1),
    (1, 0, 1, 2, 0.0, 1, 1.0, 1, 0.9, 1),
    (1, 0, 1, 40, 0.3, 25, 0.4, 3, 1.0, 1),
    (1, 0, 1, 7, 0.4, 6, 0.5, 8, 0.6, 1),
    (1, 1, 0, 8, 0.0, 0, 0.0, 5, 1.0, 1),
    (1, 0, 1, 5, 0.0, 3, 0.0, 4, 1.0, 1),
    (1, 0, 1, 3, 0.0, 2, 1.0, 4, 1.0, 1),
    (1, 0, 1, 6, 0.5, 1, 1.0, 2, 1.0, 1),
    (1, 0, 1, 12, 0.2, 6, 1.0, 3, 1.0, 1),
    (1, 0, 0, 7, 0.0, 9, 1.0, 14, 1.0, 1),
    (1, 0, 1, 3, 1.0, 0, 0.0, 5, 1.0, 1),
    (1, 0, 1, 4, 1.0, 8, 1.0, 0, 0.0, 1),
    # Inside the article, but amid a run of links: tables of contents, tag lists
    (1, 0, 1, 2, 1.0, 3, 1.0, 2, 1.0, 0),
    (1, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0),
    (1, 0, 0, 4, 1.0, 2, 1.0, 3, 1.0, 0),
    (1, 0, 1, 3, 1.0, 4, 1.0, 5, 1.0, 0),
    (1, 0, 1, 6, 1.0, 2, 1.0, 7, 1.0, 0),
    # Pages without article or main: paragraphs and running text
    (0, 0, 1, 60, 0.0, 9, 0.0, 110, 0.0, 1),
    (0, 0, 1, 110, 0.1, 60, 0.0, 24, 0.0, 1),
    (0, 0, 1, 24, 0.0, 110, 0.1, 70, 0.0, 1),
    (0, 0, 0, 180, 0.0, 8, 0.0, 45, 0.1, 1),
    (0, 0, 0, 45, 0.1, 180, 0.0, 3, 1.0, 1),
    (0, 0, 0, 30, 0.0, 5, 1.0, 26, 0.0, 1),
    (0, 0, 1, 5, 0.0, 70, 0.0, 90, 0.0, 1),
    (0, 0, 1, 2, 0.0, 55, 0.0, 40, 0.0, 1),
    (0, 0, 1, 18, 0.2, 0, 0.0, 0, 0.0, 1),
    (0, 0, 1, 8, 0.0, 26, 0.0, 30, 0.1, 1),
    (0, 0, 1, 30, 0.3, 35, 0.0, 28, 0.0, 1),
    (0, 0, 1, 4, 0.0, 33, 0.0, 0, 0.0, 1),
    (0, 0, 1, 6, 0.0, 0, 0.0, 48, 0.0, 1),
    # ... titles
    (0, 1, 0, 7, 0.0, 2, 1.0, 60, 0.0, 1),
    (0, 1, 0, 4, 0.0, 70, 0.0, 85, 0.0, 1),
    (0, 1, 0, 10, 0.0, 0, 0.0, 40, 0.0, 1),
    (0, 1, 0, 2, 0.0, 12, 0.0, 3, 1.0, 0),
    (0, 1, 0, 3, 0.0, 5, 0.1, 5, 1.0, 0),
    # ... menus, link lists, captions of page furniture, copyright lines
    (0, 0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0),
    (0, 0, 1, 3, 1.0, 2, 1.0, 4, 1.0, 0),
    (0, 0, 0, 2, 1.0, 2, 1.0, 60, 0.0, 0),
    (0, 0, 1, 2, 1.0, 3, 1.0, 75, 0.0, 0),
    (0, 0, 0, 20, 0.9, 1, 1.0, 8, 0.0, 0),
    (0, 0, 1, 14, 0.8, 45, 0.0, 12, 0.9, 0),
    (0, 0, 0, 5, 0.0, 45, 0.0, 0, 0.0, 0),
    (0, 0, 0, 9, 0.2, 3, 1.0, 0, 0.0, 0),
    (0, 0, 0, 3, 0.0, 2, 1.0, 2, 1.0, 0),
    (0, 0, 0, 6, 0.0, 0, 0.0, 1, 1.0, 0),
    (0, 0, 0, 4, 0.0, 3, 0.0, 6, 0.0, 0),
    (0, 0, 0, 8, 0.0, 60, 0.0, 2, 1.0, 0),
]
# Shapes that text around the article has; nothing in them tells it from an article: heading, paragraph, words, link density, words
# and link density of the block before, the same of the block after.
AROUND = [
    (0, 1, 1, 1.0, 0, 0.0, 0, 0.0),
    (0, 1, 2, 1.0, 0, 0.0, 8, 0.0),
    (0, 0, 9, 0.0, 0, 0.0, 8, 0.0),
    (0, 0, 14, 0.0, 35, 0.0, 0, 0.0),
    (0, 0, 25, 0.1, 0, 0.0, 14, 0.0),
    (1, 0, 4, 0.0, 64, 0.0, 8, 0.0),
    (0, 1, 60, 0.0, 140, 0.0, 0, 0.0),
    (0, 1, 70, 0.0, 210, 0.0, 40, 0.0),
    (0, 0, 130, 0.0, 30, 0.0, 0, 0.0),
    (0, 1, 200, 0.0, 90, 0.0, 180, 0.0),
]


def labelled() -> np.ndarray:
    """Rows of features (without the derived ones) and the label: every shape in several surroundings.

    frame, remark, named, outside, body, heading, paragraph, control_share, named_share, named_words, body_share, then words and
    densities as above."""
    out = []

    def add(label, body, heading, paragraph, *around, frame=0, remark=0, named=0, outside=0, control=0.0, share=0.0, held=0.0, body_share=None):
        if body_share is None:
            body_share = 0.9 if body else 0.0
        out.append((frame, remark, named, outside, body, heading, paragraph, control, share, held, body_share, *around, label))

    for body, heading, paragraph, *around, label in SHAPES:
        shape, words = (body, heading, paragraph, *around), around[0]
        add(label, *shape)
        # Names and forms that mislead: what they hold is the page.
        add(label, *shape, named=1, share=0.95, held=max(200.0, 2.0 * words))
        add(label, *shape, named=1, share=0.6, held=max(300.0, 2.0 * words))
        add(label, *shape, control=0.04)
        add(label, *shape, named=1, share=0.9, held=max(250.0, 2.0 * words), control=0.02)
    for body in (0, 1):
        for heading, paragraph, *around in [*AROUND, *(tuple(s[1:-1]) for s in SHAPES if s[0] == body and s[-1])]:
            shape, words, density = (body, heading, paragraph, *around), around[0], around[1]
            add(0, *shape, frame=1)
            add(0, *shape, remark=1)
            add(0, *shape, remark=1, named=1, share=0.7, held=300.0)
            add(0, *shape, frame=1, named=1, share=0.5, held=200.0)
            add(0, *shape, control=0.5)
            add(0, *shape, control=1.0)
            # A little of the page under such a name is what it says.
            add(0, *shape, named=1, share=0.02, held=float(words))
            add(0, *shape, named=1, share=0.2, held=words + 20.0)
            if not body:
                add(0, *shape, outside=1, body_share=0.9)
                add(0, *shape, outside=1, body_share=0.3)
                add(0, *shape, outside=1, named=1, share=0.1, held=float(words), body_share=0.6)
                # An article of a few words on a page full of text: a teaser.
                add(int(words >= 60 and density < 0.3), *shape, outside=1, body_share=0.02)
    return np.array(out, float)
