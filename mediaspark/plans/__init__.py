"""Bindings of the operators to the test tables, with the SQL that checks them."""
