"""Jobs over tables of pages, claims, changes, registers and people: DataFrames in, DataFrames out."""
