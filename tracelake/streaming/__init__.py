"""File changes as a stream: quiet gaps close a batch, and each batch brings the stored graph up to date."""
