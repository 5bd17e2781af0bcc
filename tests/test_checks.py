import pytest

from readloom.plans import checks


def test_options_are_checked(tmp_path):
    f = tmp_path / "x"
    f.write_text("")
    good = [
        (checks.text, ("a", "n"), "a"), (checks.text, ("", "n", True), ""), (checks.flag, (True, "n"), True), (checks.whole, (3.0, "n", 1), 3), (checks.number, (0, "n", 0, 1), 0.0),
        (checks.choice, ("a", "n", ("a", "b")), "a"), (checks.existing_file, (str(f), "n"), str(f)), (checks.existing_file, ("s3a://b/k", "n"), "s3a://b/k"), (checks.prefix, (str(f), "n"), str(f)), (checks.name_of_sample, ("s1",), "s1"),
    ]
    for check, args, value in good:
        assert check(*args) == value
    bad = [
        (checks.text, ("", "n")), (checks.text, (1, "n")), (checks.flag, (1, "n")), (checks.whole, (True, "n")), (checks.whole, (1.5, "n")), (checks.whole, (0, "n", 1)), (checks.whole, (9, "n", 1, 3)), (checks.whole, (float("nan"), "n")),
        (checks.number, (2, "n", 0, 1)), (checks.number, ("1", "n")), (checks.choice, ("c", "n", ("a",))), (checks.existing_file, (str(tmp_path / "no"), "n")), (checks.prefix, (str(tmp_path) + "/", "n")), (checks.prefix, ("/no/such/x", "n")), (checks.name_of_sample, ("a b",)), (checks.name_of_sample, ("a:b",)),
    ]
    for check, args in bad:
        with pytest.raises((ValueError, FileNotFoundError)):
            check(*args)
