"""Goldens for the similarity kernel (recorded values and FIXTURES.md)."""
# The names, prices and scores below are fixed values: recorded results that must be reproduced.
from pricesift.functions import fuzz

Q = "iPhone 16 Pro, 128GB"


def test_recorded_similarity_0848():
    assert round(fuzz.name_similarity("Apple iPhone 16 Pro - 128GB - Natural Titanium", Q), 3) == 0.848
    assert round(fuzz.name_similarity("Apple iPhone 16 Pro 128GB - Natural Titanium", Q), 3) == 0.848


def test_parts_of_0848():
    a = fuzz.clean_text("apple iphone 16 pro - 128gb - natural titanium")
    b = fuzz.clean_text("iphone 16 pro, 128gb")
    assert (fuzz.token_sort_ratio(a, b), fuzz.token_set_ratio(a, b), fuzz.partial_ratio(a, b)) == (62, 100, 100)


def test_recorded_similarity_0598():
    title = ("iPhone 16 Pro 128 GB: 5G Mobile Phone with Camera Control, 4K 120 fps Dolby Vision and a Huge "
             "Leap in Battery Life. Works with AirPods; White Titanium")
    assert round(fuzz.name_similarity(title, Q), 3) == 0.598


def test_fixed_shop_similarities():
    assert round(fuzz.name_similarity("Apple iPhone 16 Pro 256GB - Blue Titanium", Q), 3) == 0.722
    assert round(fuzz.name_similarity("Apple iPhone 16 Pro 512GB - White Titanium", Q), 3) == 0.730


def test_name_variants_are_mutual_duplicates():
    names = ["Apple iPhone 16 Pro 128GB - Natural Titanium", "iPhone 16 Pro 128GB Natural Titanium (Unlocked)",
             "Apple iPhone 16 Pro - 128GB - Natural Titanium",
             "iPhone 16 Pro 128GB - Natural Titanium - Factory Unlocked",
             "Apple iPhone 16 Pro (128GB) Natural Titanium"]
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            assert fuzz.name_similarity(names[i], names[j]) > 0.85


def test_ratio_edges():
    assert fuzz.ratio("", "") == 100 and fuzz.ratio("a", "") == 0 and fuzz.ratio(None, "a") == 0
    assert fuzz.lcs_len("abcde", "ace") == 3
    assert fuzz.partial_ratio("abc", "xxabcxx") == 100
