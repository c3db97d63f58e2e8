"""Column functions: each takes Columns and returns a Column, inside whole-stage codegen or
higher-order expressions, with no shuffle and no Python workers."""
