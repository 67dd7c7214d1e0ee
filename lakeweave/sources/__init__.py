"""Where tables come from and go to: views over files, and sharded copies."""
