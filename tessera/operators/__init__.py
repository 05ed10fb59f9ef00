"""Plans over DataFrames: profiles, keys, constraints, alignment and table changes."""
