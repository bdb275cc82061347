"""Reading and writing of snapshots, registers and merged tables."""
