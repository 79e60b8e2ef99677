"""Operators on texts and on records described by texts. Nothing outside this subpackage imports it."""
