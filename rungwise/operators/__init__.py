"""Relational operators: each public function takes and returns DataFrames."""
