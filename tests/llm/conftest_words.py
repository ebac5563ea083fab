import regex

WORD = regex.compile("[a-z0-9À-῿⁀-\U0010ffff]+")
EN = "The house of the old man stands near the river and there are many trees in the garden where children play all day long"


def word_list(text):
    return WORD.findall((text or "").lower())
