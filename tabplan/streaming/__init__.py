"""Jobs: semantic stages committed chunk by chunk, resumable, under limits."""
