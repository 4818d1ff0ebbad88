"""Payload decoders and encoders, one picture at a time, run by grouped Arrow functions."""
