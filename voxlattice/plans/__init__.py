"""The lazy query: its tree, validation, optimizer and lowering."""
